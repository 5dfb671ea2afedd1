"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question asked again with other values has the same template.
Windows of the benchmark's templates are joined by hash with windows of the documents' templates, on both sides at every
place; where a template has hardly any words, the window's values and a wider template are joined as well. Each meeting
fixes an alignment; there the whole item is compared token by token, and values in the slots must be renamed
consistently to count. What agrees at any of a pair's alignments is added up, so that words put in or left out lose
nothing but themselves. DataFrame functions only: whole texts are typed by a few replacements and split once, and a
window's hash is made of those of its halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import small, stored, unused

#: Tokens in a window, and in the wider one for templates with too few words. Items below the least number of tokens are too short to tell.
WINDOW, WIDE, LEAST_TOKENS = 5, 8, 5
#: A template needs so many tokens that are no placeholders, the wider one so many, one of an item that has no wider one so many.
LEAST_WORDS, LEAST_WIDE_WORDS, LEAST_SHORT_WORDS = 4, 3, 2
#: Share of an item's tokens that must agree, or the tokens in one run that do whatever the share. Of items of fewer than WIDE tokens all but one must.
SHARE, RUN = 0.5, 13
#: Units of measure after a number.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years mph kmh km/h m/s hz khz mhz ghz w kw kwh v a j kj cal kcal °c °f k % percent dollar dollars cent cents euro euros pound pounds usd eur gbp"
).split()
#: What stands for a number, a name and a unit in a template. No word is like them, as words hold no control characters.
NUM, NAME, UNIT = "\x01", "\x02", "\x03"

_SPACE = r"\x20\x09-\x0D"
_EDGE = r"[^\p{L}\p{N}\p{Sc}%°\x02" + _SPACE + "]"  # punctuation that may stand after a word
_FIXED = [
    # A name is a capitalised word that does not begin a sentence; it is marked before punctuation goes.
    (rf"\p{{Lu}}(?<=[^.!?:'\")\]{_SPACE}][{_SPACE}]{{1,3}}[\"'(\[]{{0,2}}\p{{Lu}})\p{{Ll}}+(?={_EDGE}*+[{_SPACE}])", NAME + "$0"),
    (rf"(?![A-Za-z0-9]){_EDGE}*+[{_SPACE}](?:[^\p{{L}}\p{{N}}\p{{Sc}}%°\x02+-]|[+-](?![\p{{N}}\p{{Sc}}]))*+", " "),
]
_TYPED = [
    (r" [+-]?\p{Sc}?[0-9][0-9.,:/]*+[%\p{Sc}]?(?= )", " " + NUM),
    (rf"{NUM} (?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?= )", f"{NUM} {UNIT}"),
    (rf"{NAME}[^ ]++", NAME),
]


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _words(text: Column) -> Column:
    """The words between single spaces; a text without words gives one empty word, which is in no window."""
    return F.split(F.trim(text), " ")


def with_tokens(df: DataFrame, text: Column) -> DataFrame:
    """df with `t`, the template's tokens, and `v`, their values: two arrays of one length.

    Punctuation around a word is no part of it and a word of punctuation only is left out. A number is a word of
    digits with signs, separators, currency or percent marks; a unit is one of UNITS after a number; a name is a
    capitalised word that does not begin a sentence.
    """
    plain = F.lower(_replaced(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _FIXED))
    return df.withColumn("_plain", plain).withColumn("t", _words(_replaced(F.col("_plain"), _TYPED))).withColumn("v", _words(F.replace("_plain", F.lit(NAME), F.lit("")))).drop("_plain")


def _slot(t: Column) -> Column:
    return t.isin(NUM, NAME, UNIT)


def _halves(h: Column, k: int) -> Callable[[Column], Column]:
    """Joins hashes of windows with those of windows `k` places on."""
    return lambda own: F.zip_with(own, F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _cut(h: Column, k: int) -> Column:
    """The hashes of whole windows of k tokens: what runs over the end goes."""
    return F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))


def with_windows(df: DataFrame) -> DataFrame:
    """df with arrays of window hashes by place: `t5` templates, `v5` values, `t8` wide templates."""
    one = lambda c, seed: F.transform(c, lambda x: F.xxhash64(F.lit(seed), x))
    df = df.withColumn("t1", one("t", 1)).withColumn("v1", one("v", 2))
    for s in "tv":
        df = df.withColumn(f"{s}2", _halves(F.col(f"{s}1"), 1)(F.col(f"{s}1"))).withColumn(f"{s}4", _halves(F.col(f"{s}2"), 2)(F.col(f"{s}2")))
    t8 = _cut(_halves(F.col("t4"), 4)(F.col("t4")), WIDE)
    return df.withColumn("t8", t8).withColumn("t5", _cut(_halves(F.col("t1"), 4)(F.col("t4")), WINDOW)).withColumn("v5", _cut(_halves(F.col("v1"), 4)(F.col("v4")), WINDOW)).drop("t1", "t2", "t4", "v1", "v2", "v4")


def _agreement(item: Column, doc: Column) -> Column:
    """Places of the item's tokens that agree with the document at the alignment.

    Equal words agree. Slots agree if of the same type and if, among the item's slots here, each value is always
    renamed to the same one and no two are renamed to the same; else only slots with equal values do.
    """

    def agreeing(both: Column) -> Column:
        slots = F.array_distinct(F.transform(F.filter(both, lambda x: x["same"] & _slot(x["t"])), lambda x: F.struct(x["t"], x["a"], x["b"])))
        one_to_one = lambda s: (F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["t"], x["a"])))) == F.size(s)) & (F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["t"], x["b"])))) == F.size(s))
        places = lambda ok: F.filter(F.transform(both, lambda x, i: F.when(ok(x), i)), lambda i: i.isNotNull())
        return F.when(_let(slots, one_to_one), places(lambda x: x["same"])).otherwise(places(lambda x: x["same"] & (~_slot(x["t"]) | x["a"].eqNullSafe(x["b"]))))

    return _let(F.zip_with(item, doc, lambda a, b: F.struct(a["t"].alias("t"), a["v"].alias("a"), b["v"].alias("b"), a["t"].eqNullSafe(b["t"]).alias("same"))), agreeing)


def _has_run(places: Column) -> Column:
    return F.exists(places, lambda p: F.array_contains(places, p + (RUN - 1)) & (F.size(F.filter(places, lambda q: (q >= p) & (q < p + RUN))) == RUN))



def _item_windows(items: DataFrame) -> DataFrame:
    """(h, item_id, item_pos): templates with enough words, else the values and the wider template."""
    x = with_windows(items)
    x = x.withColumn("_word", F.transform("t", lambda t: F.when(_slot(t), 0).otherwise(1)))
    count = lambda p, k: F.aggregate(F.slice("_word", p + 1, k), F.lit(0), lambda a, b: a + b)
    rich = F.transform("t5", lambda h, p: F.when(count(p, WINDOW) >= F.when(F.size("t") < WIDE, LEAST_SHORT_WORDS).otherwise(LEAST_WORDS), F.struct(p.alias("pos"), h.alias("h"))))
    values = F.transform("v5", lambda h, p: F.when(count(p, WINDOW) < LEAST_WORDS, F.struct(p.alias("pos"), h.alias("h"))))
    wide = F.transform("t8", lambda h, p: F.when((count(p, WINDOW) < LEAST_WORDS) & (count(p, WIDE) >= LEAST_WIDE_WORDS), F.struct(p.alias("pos"), h.alias("h"))))
    x = x.select("item_id", F.explode(F.array_compact(F.concat(rich, values, wide))).alias("w"))
    return x.select("w.h", "item_id", F.col("w.pos").alias("item_pos")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share): each document with each benchmark item that it holds, by the share of its tokens that agree at any alignment.

    A pair counts from SHARE on, or with RUN agreeing tokens in a row; an item of fewer than WIDE tokens may lack one. Null and empty texts and items of fewer than
    LEAST_TOKENS tokens meet nothing. Repeated rows give their pairs once. Rows with a null id are left out; empty tables
    give an empty result. Only ids and texts are read, so other columns cannot clash. Items may be many: their windows
    are broadcast only below a bound of bytes. Rows that share an id but not the text are told apart.

    Calling this runs the steps up to the meetings, which are written to the shared folder.
    """
    items = with_tokens(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("_text")).distinct(), F.col("_text"))
    items = stored(items.select("item_id", "t", "v").where(F.size("t") >= LEAST_TOKENS).distinct(), "items")
    own = stored(_item_windows(items), "item-windows")
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = with_windows(with_tokens(d.select("doc_id", F.xxhash64("text").alias("_t"), "text"), F.col("text"))).select("doc_id", "_t", "t5", "v5", "t8")
    theirs = hashed.select("doc_id", "_t", F.explode(F.array("t5", "v5", "t8")).alias("hs")).select("doc_id", "_t", F.posexplode("hs").alias("doc_pos", "h"))
    found = stored(theirs.join(small(own), "h").select("doc_id", "_t", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).distinct(), "meetings")
    # Only documents that were met are read again, and tokenised once each.
    met = found.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2")).distinct()
    met = d.withColumn("_t", F.xxhash64("text")).join(small(met), F.expr("doc_id = _d AND _t = _t2"), "left_semi").distinct()
    met = with_tokens(met, F.col("text")).select("doc_id", "_t", F.arrays_zip("t", "v").alias("tok"))
    x = found.join(met, ["doc_id", "_t"]).join(small(items.select("item_id", F.arrays_zip("t", "v").alias("item"))), "item_id")
    n = F.size("item")
    lead = F.greatest(-F.col("shift"), F.lit(0))  # tokens of the item that would stand before the document
    at = F.slice("tok", F.greatest(F.col("shift"), F.lit(0)) + 1, n - lead)
    x = x.select("doc_id", "_t", "item_id", n.alias("n"), F.transform(_agreement(F.slice("item", lead + 1, F.size(at)), at), lambda i: i + lead).alias("places"))
    x = x.groupBy("doc_id", "_t", "item_id").agg(F.max("n").alias("n"), F.flatten(F.collect_set("places")).alias("all"), F.max(_has_run(F.col("places"))).alias("run"))
    x = x.withColumn("share", F.size(F.array_distinct("all")) / F.col("n"))
    x = x.where(F.when(F.col("n") < WIDE, F.col("share") * F.col("n") >= F.col("n") - 1).otherwise((F.col("share") >= SHARE) | F.col("run")))
    return x.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per document that holds benchmark items: doc_id, item_ids (sorted), share (the largest), kept (false).

    Documents without a leak, with a null id or with a null, empty or short text have no row; repeated rows have one;
    empty tables give an empty result; other columns are not read and cannot clash.
    """
    return leaks(docs, benchmark, **columns).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share")).withColumn("kept", F.lit(False))


def cleaned(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names.

    Rows with a null id and null, empty and very long texts stay unless a leak is found in them; all rows of an id go
    if one of them leaks; repeated rows stay repeated; an empty table stays empty.
    """
    bad = stored(leaks(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "leaks")
    gone = unused(docs, "leaked")
    return docs.join(small(bad.withColumnRenamed("doc_id", gone)), F.col(id_col) == F.col(gone), "left_anti")
