"""Personal data: fixed patterns, and bootstrapped contextual extraction for identifiers that those miss.

What the fixed patterns find are seeds, and so is the value after a word that names a secret. Words are instances; groups
of digits with spaces between are one. The two words before an instance, the last one alone if it is a label, and its
shape with the word before or after it are its lexical patterns. Patterns of enough different seeds are candidates; those
that have too many other instances in a share of the texts already are set aside until more is known, and only words that
have one of the rest enter the graph. Scores go back and forth over it: a pattern is as good as the share of its
instances that are known, an instance as good as its patterns together. Patterns with a high score extract
further instances of their kind, and these are known in the next round, until a round finds nothing new. Words after the name of
a secret teach as well, but are found only where a learnt pattern has them.
DataFrame functions only; a text is matched where it is read, and only what was matched is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._shared import small, stored, unused

#: The kinds in their order, with patterns that match what the plain ones do. `\\G` or a look-behind lets a
#: run of characters be tried once instead of from each of its places; possessive marks do not change what matches.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: The kind that only the method finds, after the kinds of the fixed patterns.
SECRET = "secret"
#: Words that name a secret, and what one looks like.
NAMES_SECRET = r"(?:^|[^a-z])(?:token|secret|password|passwd|passphrase|credential|api[_-]?key|access[_-]?key|private[_-]?key)[\"'`]? ?[=:]+$"
SECRET_VALUE = r"^(?=[^ ]*[0-9])[A-Za-z0-9_+/=.~-]{12,}$"
#: What every text with a match of the fixed patterns holds, and what every text with a secret after its name does; both are quick to look for.
MAY_MATCH = r"@|[0-9]\.[0-9]+\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){15}"
MAY_NAME_SECRET = r"(?i)token|secret|passw|passp|credential|api.?key|access.?key|private.?key"
#: The score and the number of different known instances that a pattern needs to extract; the score that an instance needs.
LEAST_SCORE, LEAST_SEEDS, LEAST_INSTANCE = 0.8, 4, 0.8
#: Characters of the shortest instance: a shorter word is in too many contexts to identify anyone ("version 3" after one number too many).
LEAST_LENGTH = 3
#: One text in so many is looked through, one share after the other, for patterns that cannot be good; which are, does not hang on it.
SHARES = (64, 8)
#: Stands for a space between groups of digits, so that they are one word; one character, so places stay.
GLUE = "\ue000"
SPACE = r"\x20\x09-\x0D"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255))
        .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, _t, kind, start, end): valid matches of the fixed patterns, in code points, from one reading of the texts."""
    text = F.col("text")

    def matches(name: str, pattern: str, holds: str | None) -> Column:
        """Array of (kind, place, length of what stands between the match before and this one, value)."""
        some = (text.contains(holds) if holds else F.lit(True)) & text.rlike("[0-9]" if name != "email" else "@")
        zipped = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, p: F.struct(v.alias("value"), F.length(p).alias("before")))
        found = F.filter(F.transform(zipped, lambda z, i: F.struct(F.lit(name).alias("kind"), i.alias("pos"), z["before"].alias("before"), z["value"].alias("value"))), lambda z: z["value"].isNotNull())
        return F.when(some, found).otherwise(F.array().cast("array<struct<kind:string,pos:int,before:int,value:string>>"))

    x = docs.where(text.rlike(MAY_MATCH)).select("doc_id", "_t", F.explode(F.concat(*[matches(k, p, h) for k, (p, h) in KINDS.items()])).alias("m")).select("doc_id", "_t", "m.*")
    x = x.groupBy("doc_id", "_t", "kind", "pos").agg(F.first("before").alias("before"), F.first("value").alias("value"))  # repeated rows once
    by = W.partitionBy("doc_id", "_t", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("end", F.sum(F.col("before") + F.length("value")).over(by)).withColumn("start", F.col("end") - F.length("value"))
    return x.where(_valid(F.col("kind"), F.col("value"))).select("doc_id", "_t", "kind", "start", "end")


def _glued(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9)])\x20(?=\(?[0-9])", GLUE)


def _bare(text: Column) -> Column:
    """A word, or words between single spaces, without the punctuation around each."""
    return F.regexp_replace(text, r"(?<![^\x20])[^\p{L}\p{N}+\x20]++|(?<=[\p{L}\p{N}+])[^\p{L}\p{N}\x20]++(?![^\x20])", "")


def _seed(bare: Column, before: Column) -> Column:
    """The kind of a word that a fixed pattern matches whole, or that follows a word that names a secret; else null."""
    value = F.replace(bare, F.lit(GLUE), F.lit(" "))
    fixed = F.lit(None).cast("string")
    for k, (p, holds) in reversed(KINDS.items()):
        fixed = F.when((value.contains(holds) if holds else F.lit(True)) & value.rlike(f"^(?:{p})$") & _valid(F.lit(k), value), F.lit(k)).otherwise(fixed)
    return F.when(bare.rlike("[0-9@]"), F.coalesce(fixed, F.when(bare.rlike(SECRET_VALUE) & before.rlike(NAMES_SECRET), F.lit(SECRET))))


def _arrays(docs: DataFrame) -> DataFrame:
    """doc_id, _t and by word: `b` bare, `c` as context, `h` the hash of that, `s` the hash of the shape."""
    d = docs.select("doc_id", "_t", F.regexp_replace(_glued(F.col("text")), f"[{SPACE}]+", " ").alias("_norm"))
    d = d.withColumn("_b", _bare(F.col("_norm"))).withColumn("_c", F.lower(F.regexp_replace("_norm", "[0-9]+", "9")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("_b", r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), "[0-9]+", "9")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    d = d.select("doc_id", "_t", F.split("_b", " ", -1).alias("b"), F.split("_c", " ", -1).alias("c"), hashes(F.split(shape, " ", -1)).alias("s"))
    return d.withColumn("h", hashes(F.col("c")))


def _is_label(word: Column) -> Column:
    return F.endswith(word, F.lit(":")) | F.endswith(word, F.lit("="))


#: Hashes of patterns: two words before, a label before, a word before with the shape, a word after with the shape.
TWO, LABEL, BEFORE, AFTER = (lambda *h, k=k: F.xxhash64(F.lit(k), *h) for k in range(4))


def words(docs: DataFrame, seeds_only: bool = False) -> DataFrame:
    """(doc_id, _t, k, v, patterns): the k-th word, the hash of its bare form, and the hashes of its patterns (null: none); with `seeds_only` the seeds with their kind `seed`."""
    text = F.col("text")
    d = _arrays(docs.where(text.rlike(MAY_MATCH) | text.rlike(MAY_NAME_SECRET)) if seeds_only else docs)
    before = lambda i: F.concat_ws(" ", F.get("c", i - 2), F.get("c", i - 1))
    places = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.length(F.get("b", i)) >= LEAST_LENGTH)
    if seeds_only:
        places = F.filter(places, lambda i: _seed(F.get("b", i), before(i)).isNotNull())

    def word(i: Column) -> Column:
        bare, last, own, said = F.get("b", i), F.get("h", i - 1), F.get("s", i), F.get("c", i - 1)
        patterns = F.array(F.when(i >= 2, TWO(F.get("h", i - 2), last)), F.when(_is_label(said), LABEL(last)), F.when(i >= 1, BEFORE(last, own)), F.when(i < F.size("h") - 1, AFTER(F.get("h", i + 1), own)))
        kind = [_seed(bare, before(i)).alias("seed")] if seeds_only else []
        return F.struct(i.alias("k"), F.xxhash64(bare).alias("v"), *kind, patterns.alias("patterns"))

    # The words' structs are made before they become rows, which would each carry the arrays of the text.
    x = d.select("doc_id", "_t", F.explode(F.transform(places, word)).alias("w")).select("doc_id", "_t", "w.*")
    return x.withColumn("patterns", F.array_compact("patterns")) if seeds_only else x


def _that_hold(docs: DataFrame, hashes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents of which hashes (doc_id, _t, x) has one of wanted (x)."""
    keys = stored(hashes.join(small(wanted), "x", "left_semi").select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2")).distinct(), "having")
    return docs.join(small(keys), F.expr("doc_id <=> _d AND _t = _t2"), "left_semi")


def _having(docs: DataFrame, values: DataFrame) -> DataFrame:
    """The documents in which a word's bare form is one of the values (v)."""
    norm = F.regexp_replace(_glued(F.col("text")), f"[{SPACE}]+", " ")
    hashes = docs.select("doc_id", "_t", F.explode(F.transform(F.split(_bare(norm), " ", -1), lambda w: F.xxhash64(w))).alias("x"))
    return _that_hold(docs, hashes, values.select(F.col("v").alias("x")))


def _good(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(p, kind, score) of the patterns that extract: score is the share of a pattern's instances that are known as one kind, each by its own score, and enough of them are."""
    sizes = edges.groupBy("p").agg(F.count("*").alias("all"))
    by_kind = edges.join(known, "v").groupBy("p", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("k"))
    best = by_kind.groupBy("p").agg(F.max(F.struct("s", "k", "kind")).alias("b")).join(sizes, "p").select("p", F.col("b.kind").alias("kind"), (F.col("b.s") / F.col("all")).alias("score"), F.col("b.k").alias("seeds"))
    return best.where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS)).drop("seeds")


def _learnt(edges: DataFrame, seeds: DataFrame, before: DataFrame | None) -> DataFrame:
    """(v, kind, score) of the instances that are no seeds, by the patterns of all edges (v, p), from `before` in rounds until no score changes.

    An instance is as good as its good patterns of a kind together: it is missed only if all of them are wrong. Each round scores all
    patterns and all instances anew, in whole hundredths. Scores only rise with what is known, so rounds end, and where they end does not
    hang on which patterns were read first.
    """
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.round(F.col("score") * 100).cast("long"))).first())
    found, was = before, None if before is None else sign(before)
    while True:
        good = stored(_good(edges, seeds if found is None else seeds.unionByName(found)), "patterns")
        open_edges = edges.join(seeds.select("v"), "v", "left_anti")
        each = open_edges.join(good, "p").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("score"))
        best = each.groupBy("v").agg(F.max(F.struct(F.floor(F.col("score") * 100 + 1e-6).alias("s"), "kind")).alias("b"))
        found = stored(best.select("v", "b.kind", (F.col("b.s") / 100).alias("score")).where(F.col("score") >= LEAST_INSTANCE), "found")
        now = sign(found)
        if now == was or not now[0]:
            return found
        was = now


def _elsewhere(docs: DataFrame, values: DataFrame) -> DataFrame:
    """(v, p): the patterns of values (v) wherever these stand."""
    values = stored(values, "values")
    if values.isEmpty():
        return values.withColumn("p", F.col("v"))
    return stored(words(_having(docs, values)).join(small(values), "v").select("v", F.explode(F.array_compact("patterns")).alias("p")).distinct(), "elsewhere")


def _hopeful(docs: DataFrame, candidates: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates (p) that may be good by what is known: evidence has all (v, p) of the known (v), wherever they stand.

    A pattern's score is at most the share of known ones among its instances. Unknown ones that it has in a share of the texts it has
    in all of them, so a pattern for which they are too many there is not good, and its other instances need not be read. A common pattern
    goes in the first share already, so that what the last reading finds grows with what is known and not with how common patterns are.
    """
    most = stored(evidence.distinct().groupBy("p").agg(F.count("*").alias("most")).join(candidates, "p", "left_semi"), "most")
    for share in SHARES:
        some = words(docs.where(F.pmod("_t", F.lit(share)) == 0)).select("v", F.explode(F.array_compact("patterns")).alias("p"))
        unknown = some.join(small(candidates), "p", "left_semi").distinct().join(known, "v", "left_anti").groupBy("p").agg(F.count("*").alias("unknown"))
        bad = unknown.join(most, "p").where(F.col("most") / (F.col("most") + F.col("unknown")) < LEAST_SCORE)
        candidates = stored(candidates.join(bad, "p", "left_anti"), "hopeful")
    return candidates


def discovered(docs: DataFrame) -> DataFrame:
    """(doc_id, _t, kind, start, end) of the words that learnt patterns extract and that are no seeds of a fixed pattern's kind.

    Seeds of the kind `secret` only teach: one is a span if a good pattern of that kind has it. The rounds go on until there is
    no new candidate pattern and no new instance; candidates that were not good enough are scored again with all that is known, and those
    set aside are looked at again. Each round that has new candidates reads the texts once for the words that have one, and once for where
    else new instances stand; those are no seeds anywhere.
    """
    occurrences = stored(words(docs, True), "seeds")
    known = stored(occurrences.groupBy("v").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0)), "known")
    evidence = occurrences.select("v", F.col("seed").alias("kind"), F.explode("patterns").alias("p")).distinct()
    tried = edges = spans = found = located_ones = elsewhere = None
    while True:
        # Patterns with enough different known instances of one kind; summed before they are shuffled.
        candidates = evidence.groupBy("p", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("p").distinct()
        candidates = stored(candidates if tried is None else candidates.join(tried, "p", "left_anti"), "candidates")
        if candidates.isEmpty():
            break
        if elsewhere is None:  # what a secret's name stands before is no evidence at other places, but known there
            elsewhere = _elsewhere(docs, known.where(F.col("kind") == SECRET).select("v"))
        every = known.select("v") if located_ones is None else known.select("v").unionByName(located_ones)
        candidates = _hopeful(docs, candidates, evidence.select("v", "p").unionByName(elsewhere), every)
        if candidates.isEmpty():
            break
        tried = candidates if tried is None else tried.unionByName(candidates)
        more = stored(words(docs).select("v", F.explode(F.array_compact("patterns")).alias("p")).join(small(candidates), "p").select("v", "p").distinct(), "edges")
        edges = more if edges is None else edges.unionByName(more)
        found = _learnt(edges, known, found)
        new = found if located_ones is None else stored(found.join(located_ones, "v", "left_anti"), "new")
        if new.isEmpty():
            break
        located_ones = new.select("v") if located_ones is None else located_ones.unionByName(new.select("v"))
        where = stored(words(_having(docs, new)).join(small(new.select("v", "kind")), "v").select("doc_id", "_t", "k", "v", "kind", "patterns"), "where")
        spans = where.select("doc_id", "_t", "k", "kind") if spans is None else spans.unionByName(where.select("doc_id", "_t", "k", "kind"))
        evidence = evidence.unionByName(where.select("v", "kind", F.explode(F.array_compact("patterns")).alias("p")).distinct()).distinct()
    secrets = occurrences.where(F.col("seed") == SECRET)
    if edges is None:
        secrets = secrets.limit(0)
    else:
        taught = edges.join(stored(_good(edges, known if found is None else known.unionByName(found)), "good-patterns").where(F.col("kind") == SECRET), "p").select("v").distinct()
        secrets = secrets.join(stored(taught, "taught"), "v", "left_semi")
    secrets = secrets.select("doc_id", "_t", "k", F.col("seed").alias("kind"))
    return _placed(docs, stored((secrets if spans is None else spans.unionByName(secrets)).distinct(), "found-words"))


def _placed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (doc_id, _t, k, kind) with start and end: words are counted over one sorted pass of the texts that have any."""
    keys = spans.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2")).distinct()
    some = docs.join(small(keys), F.expr("doc_id <=> _d AND _t = _t2"), "left_semi").dropDuplicates(["doc_id", "_t"])
    # Pieces are a word with the white space after it, so their lengths add up to places; the first may be white space only.
    pieces = some.select("doc_id", "_t", F.posexplode(F.split(_glued(F.col("text")), rf"(?<=[{SPACE}])(?![{SPACE}])", -1)).alias("k", "piece"))
    so_far = W.partitionBy("doc_id", "_t").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    word = F.regexp_replace("piece", f"[{SPACE}]+", "")
    x = pieces.select("doc_id", "_t", "k", word.alias("word"), (F.sum(F.length("piece")).over(so_far) - F.length("piece")).alias("at"))
    x = x.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"), F.col("k").alias("_k"), F.length(F.regexp_extract("word", r"^[^\p{L}\p{N}+]*", 0)).alias("lead"), F.length(_bare(F.col("word"))).alias("n"), "at")
    at = spans.join(x, F.expr("doc_id <=> _d AND _t = _t2 AND k = _k"))
    return at.select("doc_id", "_t", "kind", (F.col("at") + F.col("lead")).alias("start"), (F.col("at") + F.col("lead") + F.col("n")).alias("end"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and `_t`, a hash of the text that tells apart rows with the same id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_t"))


def spans_of(keyed_docs: DataFrame) -> DataFrame:
    """(doc_id, _t, spans): arrays of (k, start, end, kind, base) in the order of kinds, then start, of documents that have any.

    Spans of the fixed patterns have base true; what the method finds is left out where it overlaps one of them.
    """
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind"))
    both = located(keyed_docs).withColumn("base", F.lit(True)).unionByName(discovered(keyed_docs).withColumn("base", F.lit(False)))
    # The end of the base span that begins last before this one's end, in one sorted pass.
    at = F.when(F.col("base"), F.col("start")).otherwise(F.col("end") - 1)
    so_far = W.partitionBy("doc_id", "_t").orderBy("_at", F.col("base").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_at", at).withColumn("_end", F.max(F.when(F.col("base"), F.col("end"))).over(so_far))
    both = both.where(F.col("base") | F.col("_end").isNull() | (F.col("_end") <= F.col("start")))
    return both.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "start", "end", "kind", "base"))).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and `spans`, an array of (k, start, end, kind, base) in the order of kinds, then start; code points, end exclusive.

    Null texts are empty and have no spans. Repeated rows get the same spans each; rows that share an id but not the
    text are told apart. An empty table gives an empty result. Only the id and the text are read, so other columns
    cannot clash. Very long texts are matched whole, in time that grows with their length.

    Calling this runs the rounds, whose steps are written to the shared folder.
    """
    k = keyed(docs, id_col, text_col)
    got = spans_of(k)
    none = F.array().cast(got.schema["spans"].dataType)
    mine = k.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_t2"))
    return mine.join(got, F.expr("doc_id <=> _d AND _t = _t2"), "left").select(F.col("_d").alias("doc_id"), F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts of each kind's base spans, their SHA-256 and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    say = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(say(base), 256).alias("base_sha256"), say(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, whatever their names, every span in the text replaced by its kind in angle brackets.

    Spans that overlap are replaced together, by the kind of the one that starts first. Null and empty texts and texts
    without spans stay as they are, also with a null id; repeated rows are redacted each; an empty table stays empty.
    Only texts that have spans are shuffled, if their keys are few bytes.
    """
    spans = stored(spans_of(keyed(docs, id_col, text_col)), "all-spans")
    # Overlapping spans as one: an array sorted by place is folded where it is.
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    exploded = spans.select("doc_id", "_t", F.posexplode(by_place).alias("i", "s"))
    before = W.partitionBy("doc_id", "_t").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("doc_id", "_t").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = exploded.select("doc_id", "_t", "i", "s.start", (-F.col("s.less")).alias("end"), "s.kind")
    x = x.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_run", F.sum("_new").over(so_far))
    x = x.groupBy("doc_id", "_t", "_run").agg(F.min(F.struct("start", "kind")).alias("s"), F.max("end").alias("end"))
    own_id, own_t, own_cuts = (unused(docs, c) for c in ("cut_id", "cut_text", "cuts"))
    cuts = x.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_list(F.struct("s.start", "end", "s.kind"))).alias(own_cuts)).select(F.col("doc_id").alias(own_id), F.col("_t").alias(own_t), own_cuts)
    cuts = stored(cuts, "cuts")
    text, c = F.col(text_col), F.col(own_cuts)
    since = lambda i: F.when(i == 0, 0).otherwise(c[i - 1]["end"])
    piece = lambda s, i: F.concat(F.substring(text, since(i) + 1, s["start"] - since(i)), F.lit("<"), s["kind"], F.lit(">"))
    new = F.concat(F.array_join(F.transform(c, piece), ""), F.substring(text, F.element_at(c, -1)["end"] + 1, F.length(text)))
    here = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_t))
    cut = lambda joined: joined.withColumn(text_col, F.when(c.isNull(), text).otherwise(new)).select(*docs.columns)
    keys = cuts.select(own_id, own_t)
    few = small(keys)
    if few is keys:
        return cut(docs.join(cuts, here, "left"))
    return docs.join(few, here, "left_anti").unionByName(cut(docs.join(few, here, "left_semi").join(cuts, here)))
