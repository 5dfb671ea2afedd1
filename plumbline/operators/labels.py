"""What label texts say: designations with their dimension, unreadable characters, legends, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import compressed_pattern
from plumbline.operators import spatial
from plumbline.sources.shared import stored

#: Nominal sizes of pipes (DN, copper and plastic series), as evidence that a number is a dimension.
NOMINAL_SIZES = [
    6, 8, 10, 12, 15, 16, 18, 20, 22, 25, 28, 32, 35, 40, 42, 50, 54, 63, 65, 75, 76, 80, 90, 100, 108, 110, 125, 133, 140, 150, 160, 168, 200,
    219, 225, 250, 300, 315, 350, 400, 450, 500, 600, 630,
]
#: Letters that stand for digits where only a number can be, and the point of a PDF in millimetres.
LOOK_ALIKES, MM_PER_PT = ("OoSsIlLBZzGgq", "0055111822699"), 25.4 / 72
#: A token position is the dimension's if so many of a pattern's words have a number there, and so many of the numbers are nominal sizes.
NUMERIC_SHARE, NOMINAL_SHARE, RARE = 0.8, 0.6, 2
#: Rows below a designation in which its dimension may stand.
BELOW = 2
#: Legend: tolerance of a baseline and reach to the right, in heights; longest code.
BASELINE, RIGHT, LONGEST_CODE = 0.6, 12.0, 12
#: Words of another reading: least confidence, least shared part of the boxes.
CONFIDENT, SHARED = 0.55, 0.35
#: A printed ratio counts from 1:5 to 1:5000, in a short row or beside a word that says so; it and a bar agree within so much.
RATIOS, SHORT_ROW, AGREE = (5, 5000), 14, 0.03

CODE = r"^[A-Za-zÅÄÖØ0-9\-/+.,:()\[\]]{2,24}$"
COUNT = r"^(\d{1,2})[xX](.+)$"
TAIL = r"^[(\[]?[A-ZÅÄÖ]{1,3}[)\]]?$|^\d{1,4}$"


def is_code(word: Column) -> Column:
    """Letters and digits, code characters only, the first one a letter, after a count at most."""
    head = F.when(word.rlike(COUNT), F.regexp_extract(word, COUNT, 2)).otherwise(word)
    return word.rlike(CODE) & word.rlike(r"\p{L}") & word.rlike("[0-9]") & head.rlike(r"^\p{L}")


def counted(word: Column) -> Column:
    """(n, rest) of '3xKV1-20'; a count is one only before a code with a separator."""
    rest = F.regexp_extract(word, COUNT, 2)
    real = word.rlike(COUNT) & is_code(rest) & rest.rlike("[-/]")
    return F.struct(F.when(real, F.regexp_extract(word, COUNT, 1).cast("int")).otherwise(1).alias("n"), F.when(real, rest).otherwise(word).alias("rest"))


def _separated(word: Column) -> Column:
    return word.rlike("[-/]") | word.rlike(r"^[A-ZÅÄÖ]{1,4}\d{1,4}[A-ZÅÄÖ]{0,3}$")


def row_role(text: Column) -> Column:
    """What a row of a label is: a dimension, an elevation, a designation, a note, or nothing."""
    t = F.trim(text)
    words = F.split(t, " ")
    packed = F.regexp_replace(t, " ", "")
    size, tail = F.regexp_extract(packed, r"^(\d{1,4})", 1), F.regexp_extract(packed, r"^\d{1,4}(.*)$", 1)
    nominal = size.try_cast("int").isin(NOMINAL_SIZES)
    qualified = ((F.length(tail) <= 4) & ~tail.rlike(r"\d")) | tail.rlike(r"^[^A-Za-z0-9]?(?![Xx]\d)[A-ZÅÄÖa-zåäö]{1,2}\d{1,3}[)\]]?$")
    one = F.size(words) == 1
    level = packed.rlike(r"^([A-ZÅÄÖ]{1,4})\s*([+\-]\s*\d+[.,]?\d*|\d+[.,]\d+)$") | ((F.size(words) == 2) & words[0].rlike("^[A-ZÅÄÖ]{1,4}$") & F.try_element_at(words, F.lit(2)).rlike(r"^[+\-]?\d+[.,]?\d*$"))
    named = is_code(words[0]) & _separated(words[0])
    code = (
        (one & (named | (counted(words[0]).n > 1)))
        | (~one & named & F.forall(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(TAIL)))
        | (~one & F.forall(words, lambda w: is_code(counted(w).rest) & _separated(counted(w).rest)))
    )
    return F.when(t == "", "text").when((one & t.rlike(r"^\d{1,4}$")) | (nominal & qualified), "dn").when(level, "elevation").when(code, "designation").otherwise("note")


def tokens(word: Column) -> Column:
    return F.filter(F.split(word, r"[\-/+.,:()\[\]]+"), lambda t: t != "")


def designations(rows: DataFrame) -> DataFrame:
    """(sheet, block, row, word, text, n, pattern, system, dn, dn_source, dn_row) of label rows (sheet, block, row, text, x0, x1).

    A row of several codes gives one designation each, any other its first code. The dimension is inline where the sheet's words of that
    pattern have a number at one place that is mostly a nominal size, or where a rare pattern has one number and it is a nominal
    size; else it stands in one of the next BELOW rows of the block, before the next designation, and for one of several codes
    over or under it. Neighbouring rows are windows, the sheet's patterns one aggregation.
    """
    w = W.partitionBy("sheet", "block").orderBy("row")
    r = rows.select("sheet", "block", "row", F.trim(F.regexp_replace("text", " +", " ")).alias("text"), "x0", "x1").where("text IS NOT NULL").withColumn("role", row_role(F.col("text")))
    after = [F.struct(F.lead("role", k).over(w).alias("role"), F.lead("text", k).over(w).alias("text"), F.lead("row", k).over(w).alias("row"), F.lead("x0", k).over(w).alias("x0"), F.lead("x1", k).over(w).alias("x1")) for k in range(1, BELOW + 1)]
    d = r.withColumn("below", F.array(*after)).where("role = 'designation'").withColumn("words", F.transform(F.split("text", " "), lambda x: F.when(F.rtrim(x, F.lit(",;")) == "", x).otherwise(F.rtrim(x, F.lit(",;")))))
    several = (F.size("words") >= 2) & F.forall("words", lambda x: is_code(counted(x).rest))
    placed = F.transform("words", lambda x, i: F.struct(x.alias("word"), i.alias("k"), (F.length(F.array_join(F.slice("words", F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)).alias("from")))
    chosen = F.when(several, placed).when(F.size("words") == 1, placed).otherwise(F.slice(F.filter(placed, lambda p: is_code(p.word)), 1, 1))
    d = d.select("sheet", "block", "row", "below", F.col("x0").alias("rx0"), (F.col("x1") - F.col("x0")).alias("wide"), F.length("text").alias("chars"), several.alias("several"), F.explode(chosen).alias("p"))
    c = counted(F.col("p.word"))
    d = d.select("sheet", "block", "row", "below", "several", F.col("p.k").alias("word"), c.n.alias("n"), c.rest.alias("text"), (F.col("rx0") + F.col("wide") * F.col("p.from") / F.col("chars")).alias("wx0"), (F.col("rx0") + F.col("wide") * (F.col("p.from") + F.length("p.word")) / F.col("chars")).alias("wx1"))
    d = stored(d.withColumn("pattern", compressed_pattern(F.col("text"))).withColumn("tokens", tokens(F.col("text"))), "designations")
    size = d.groupBy("sheet", "pattern").agg(F.count("*").alias("count"))
    at = d.select("sheet", "pattern", F.posexplode("tokens").alias("i", "t")).where(F.col("t").rlike(r"^\d+$") & (F.col("i") > 0))
    at = at.groupBy("sheet", "pattern", "i").agg(F.count("*").alias("numbers"), F.count_if(F.col("t").try_cast("int").isin(NOMINAL_SIZES)).alias("nominal")).join(size, ["sheet", "pattern"])
    good = at.where((F.col("numbers") >= NUMERIC_SHARE * F.col("count")) & (F.col("nominal") >= NOMINAL_SHARE * F.col("numbers"))).withColumn("share", F.col("nominal") / F.col("numbers"))
    v = W.partitionBy("sheet", "pattern")
    best = good.withColumn("_top", F.max("share").over(v)).groupBy("sheet", "pattern").agg(F.max_by("i", "share").alias("at"), F.count_if(F.col("share") == F.col("_top")).alias("tied"))
    best = best.where("tied = 1").select("sheet", "pattern", "at")
    d = d.join(size, ["sheet", "pattern"]).join(best, ["sheet", "pattern"], "left")
    number = F.when(F.try_element_at("tokens", F.col("at") + 1).rlike(r"^\d+$"), F.try_element_at("tokens", F.col("at") + 1).try_cast("int"))
    numeric = F.filter("tokens", lambda t: t.rlike(r"^\d+$"))
    place = F.array_position(F.transform("tokens", lambda t: t.rlike(r"^\d+$")), True)
    lone = F.when((F.col("count") <= RARE) & (F.size(numeric) == 1) & (place > 1) & numeric[0].try_cast("int").isin(NOMINAL_SIZES), F.try_element_at(numeric, F.lit(1)).try_cast("int"))
    inline = F.coalesce(F.when(number.between(6, 1200), number), lone)
    own_numbers = F.col("at").isNull() & F.exists(F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))), lambda t: t.rlike(r"^\d+$"))
    value = lambda b: F.regexp_extract(b.text, r"^(\d{1,4})", 1).try_cast("int")
    fits = lambda b: (b.role == "dn") & value(b).between(6, 1200) & (~F.col("several") | (F.least("wx1", b.x1) - F.greatest("wx0", b.x0) > 0))
    until = F.array_position(F.transform("below", lambda b: F.coalesce(b.role == "designation", F.lit(False))), True)
    reach = F.when(until > 0, F.slice("below", F.lit(1), F.greatest(until.cast("int") - 1, F.lit(0)))).otherwise(F.col("below"))
    under = F.try_element_at(F.filter(reach, fits), F.lit(1))
    found = d.withColumn("_in", inline).withColumn("_under", F.when(inline.isNull() & ~own_numbers, under))
    return found.select(
        "sheet", "block", "row", "word", "text", "n", "pattern", F.coalesce(F.try_element_at("tokens", F.lit(1)), F.lit("")).alias("system"), F.coalesce(F.col("_in"), value(F.col("_under"))).alias("dn"),
        F.when(F.col("_in").isNotNull(), "inline").when(F.col("_under").isNotNull(), "row").alias("dn_source"), F.col("_under.row").alias("dn_row"),
    )


def vocabulary(layers: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by, word): the code-like words of layer names: three characters or more, letters and digits."""
    w = layers.select(*by, F.explode(F.split(F.upper(name), "[^A-Z0-9]+")).alias("word"))
    return w.where((F.length("word") >= 3) & F.col("word").rlike("[A-Z]") & F.col("word").rlike("[0-9]")).distinct()


def named_from_vocabulary(words: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, char, words): glyph families that known words name; words: by, word with `?` for what cannot be read, family of that glyph.

    A word with one gap and three characters besides meets the known words through their one-gap forms, an equi-join; it votes if all known
    words of that form have one character there. A family is named if all its votes agree.
    """
    gaps = known.select(*by, "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k"))
    forms = gaps.select(*by, F.concat(F.expr("substring(word, 1, k - 1)"), F.lit("?"), F.expr("substring(word, k + 1)")).alias("form"), F.expr("substring(word, k, 1)").alias("char"))
    one = forms.groupBy(*by, "form").agg(F.count_distinct("char").alias("_n"), F.min("char").alias("char")).where("_n = 1").drop("_n")
    asked = words.select(*by, "family", F.upper("word").alias("form")).where("length(form) - length(replace(form, '?', '')) = 1 AND length(form) >= 4")
    votes = asked.join(one, [*by, "form"])
    return votes.groupBy(*by, "family").agg(F.count_distinct("char").alias("_n"), F.min("char").alias("char"), F.array_sort(F.collect_set(F.expr("replace(form, '?', char)"))).alias("words")).where("_n = 1").drop("_n")


def legend_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, code, description, other): rows that are a code with its description; rows: by, id, text, x0, y0, x1, y1.

    A description stands in the row itself, after the code, or is the nearest text to the right on the same baseline, within BASELINE and RIGHT
    heights of the code's row. Rows meet by bands of baselines of a fixed width, the code reaching into its neighbours.
    """
    r = rows.withColumn("text", F.trim("text")).where("text <> ''").withColumn("h", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)))
    form = r"^([A-ZÅÄÖ]{1,4}[0-9]{0,3}[A-ZÅÄÖ]{0,2})\s*(?:[=:\-]\s*|\s{1,})(\p{L}.*)$"
    inline = r.where(F.col("text").rlike(form) & (F.length(F.regexp_extract("text", form, 1)) <= LONGEST_CODE))
    inline = inline.select(*by, "id", F.regexp_extract("text", form, 1).alias("code"), F.regexp_extract("text", form, 2).alias("description"), F.lit(None).cast(rows.schema["id"].dataType).alias("other"))
    codes = r.join(inline.select(*by, "id"), [*by, "id"], "left_anti").where((F.length("text") <= LONGEST_CODE) & ~F.col("text").contains(" "))
    band = lambda y: F.floor(y / 2.0)
    codes = codes.select(*by, "id", F.col("text").alias("code"), "x1", "y0", "h", F.explode(F.sequence(band(F.col("y0") - BASELINE * F.col("h")), band(F.col("y0") + BASELINE * F.col("h")))).alias("band"))
    texts = r.select(*by, F.col("id").alias("other"), F.col("text").alias("description"), F.col("x0").alias("ox"), F.col("y0").alias("oy"), band(F.col("y0")).alias("band"))
    gap = F.greatest(F.col("ox") - F.col("x1"), F.lit(0.0))
    near = codes.join(texts, [*by, "band"]).where((F.col("id") != F.col("other")) & (F.col("ox") > F.col("x1") - 0.1) & (F.abs(F.col("oy") - F.col("y0")) <= BASELINE * F.col("h")) & (gap <= RIGHT * F.col("h")))
    best = near.groupBy(*by, "id", "code").agg(F.min(F.struct(gap.alias("gap"), "other", "description")).alias("b")).where(F.col("b.description").rlike(r"\p{L}"))
    return inline.unionByName(best.select(*by, "id", "code", "b.description", "b.other"))


def aligned(words: DataFrame, others: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by, id, word, other, filled, confidence): unreadable characters of words filled from another reading of the same place.

    words: by, id, word with `?`, box; others: by, text, confidence, box. The other word is as long, agrees wherever ours is sure (the case of letters aside), and
    shares SHARED of the smaller box; of several the one that shares most, then the surest, then the first by text.
    """
    asked = words.where("word LIKE '%?%' AND replace(word, '?', '') <> ''")
    sure = others.where(F.col("confidence") >= CONFIDENT)
    met = spatial.box_join(asked, sure, cell, by=tuple(by)).where(F.length("word") == F.length("r_text"))
    agrees = F.forall(F.sequence(F.lit(1), F.length("word")), lambda k: (F.substr("word", k, F.lit(1)) == "?") | (F.upper(F.substr("word", k, F.lit(1))) == F.upper(F.substr("r_text", k, F.lit(1)))))
    area = lambda p: F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))
    both = F.greatest(F.least("x1", "r_x1") - F.greatest("x0", "r_x0"), F.lit(0.0)) * F.greatest(F.least("y1", "r_y1") - F.greatest("y0", "r_y0"), F.lit(0.0))
    share = both / F.nullif(F.least(area(""), area("r_")), F.lit(0.0))
    met = met.withColumn("share", F.round(share, 6)).where((F.col("share") >= SHARED) & agrees)
    best = met.groupBy(*by, "id", "word").agg(F.max_by(F.struct(F.col("r_text").alias("text"), F.col("r_confidence").alias("confidence")), F.struct("share", "r_confidence", F.transform(F.split(F.col("r_text"), ""), lambda c: -F.ascii(c)))).alias("b"))
    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.when(F.substr("word", k, F.lit(1)) == "?", F.upper(F.substr("b.text", k, F.lit(1)))).otherwise(F.substr("word", k, F.lit(1)))), "")
    return best.select(*by, "id", "word", F.col("b.text").alias("other"), filled.alias("filled"), F.col("b.confidence").alias("confidence"))


def printed_ratios(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, ratio): scales printed as 1:N in texts, look-alike letters read as digits; in a short row or beside a word or sheet format that says it is one."""
    packed = F.regexp_replace("text", " ", "")
    digits = "0-9" + LOOK_ALIKES[0]
    found = F.regexp_extract_all(packed, F.lit(rf"1[:;]([{digits}]{{1,4}})(?![{digits}])"), F.lit(1))
    said = (F.length(packed) <= SHORT_ROW) | F.upper("text").rlike(r"SKALA|SCALE|\(A[0-4]\)")
    r = rows.where(said).select(*by, F.explode(found).alias("d")).select(*by, F.translate("d", *LOOK_ALIKES).try_cast("int").alias("ratio"))
    return r.where(F.col("ratio").between(*RATIOS)).distinct()


def bar_scales(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, m_per_pt): scale bars: three numbers or more on one line, rising evenly with their place; labels: by, line, x, text with or without a unit.

    A unit written at one label or beside them holds for all; without one the numbers are metres. The spacing is even if no step
    is further than AGREE from the whole. Of several bars the longest counts.
    """
    form = r"^(\d{1,5}(?:[.,]\d{1,3})?)(mm|cm|dm|m)?$"
    t = F.lower(F.regexp_replace("text", r"[ :;]", ""))
    each = labels.select(*by, "line", "x", F.regexp_replace(F.regexp_extract(t, form, 1), ",", ".").try_cast("double").alias("value"), F.when(t.rlike("^(mm|cm|dm|m)\\.?$"), F.regexp_extract(t, "^(mm|cm|dm|m)", 1)).otherwise(F.nullif(F.regexp_extract(t, form, 2), F.lit(""))).alias("unit"))
    unit = F.min("unit").over(W.partitionBy(*by, "line"))
    n = each.withColumn("u", unit).where("value IS NOT NULL")
    w = W.partitionBy(*by, "line").orderBy("x")
    n = n.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dv", F.col("value") - F.lag("value").over(w))
    g = n.groupBy(*by, "line").agg(F.count("*").alias("n"), F.min("dx").alias("least"), F.min("dv").alias("rise"), (F.max("x") - F.min("x")).alias("span"), (F.max("value") - F.min("value")).alias("total"), F.min(F.col("dv") / F.col("dx")).alias("lo"), F.max(F.col("dv") / F.col("dx")).alias("hi"), F.min("u").alias("u"))
    per = F.col("total") / F.col("span")
    g = g.where((F.col("n") >= 3) & (F.col("least") > 0) & (F.col("rise") > 0) & (F.col("lo") >= (1 - AGREE) * per) & (F.col("hi") <= (1 + AGREE) * per))
    metres = F.create_map(*[F.lit(x) for kv in {"mm": 0.001, "cm": 0.01, "dm": 0.1, "m": 1.0}.items() for x in kv])
    g = g.withColumn("m_per_pt", per * F.coalesce(F.try_element_at(metres, F.col("u")), F.lit(1.0)))
    return g.groupBy(*by).agg(F.max_by("m_per_pt", F.struct("span", "m_per_pt")).alias("m_per_pt"))


def scales(sheets: DataFrame, rows: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """(by, scale_state, m_per_pt, ratios) of each sheet: what its texts print against what its bar measures.

    VERIFIED: a printed ratio and the bar agree within AGREE, the ratio's exact value counts; CONFLICT: they disagree, the bar counts, or several
    ratios are printed and there is no bar, and nothing counts; TEXT_ONLY, BAR_ONLY: one of them; NONE.
    """
    ratio = printed_ratios(rows, by).withColumn("v", F.col("ratio") * F.lit(MM_PER_PT / 1000))
    both = sheets.select(*by).distinct().join(bar_scales(bars, by).withColumnRenamed("m_per_pt", "bar"), by, "left").join(ratio, by, "left")
    fits = F.abs(F.col("v") - F.col("bar")) / F.col("bar") <= AGREE
    g = both.groupBy(*by, "bar").agg(F.min(F.when(fits, F.struct(F.abs(F.col("v") - F.col("bar")).alias("d"), "v"))).alias("fit"), F.array_sort(F.collect_set("ratio")).alias("ratios"), F.min("v").alias("v"))
    n = F.size("ratios")
    state = F.when(F.col("fit").isNotNull(), "VERIFIED").when(F.col("bar").isNotNull() & (n > 0), "CONFLICT").when(F.col("bar").isNotNull(), "BAR_ONLY").when(n == 1, "TEXT_ONLY").when(n > 1, "CONFLICT").otherwise("NONE")
    return g.select(*by, state.alias("scale_state"), F.when(F.col("fit").isNotNull(), F.col("fit.v")).when(F.col("bar").isNotNull(), F.col("bar")).when(n == 1, F.col("v")).alias("m_per_pt"), "ratios")
