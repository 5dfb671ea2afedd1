"""Phrase collocations: Misra-Gries summaries of n-grams per hash partition, then exact counts of what they keep.

First pass. Tasks sum the n-grams of a stretch of text by hash and deal the sums by the hash's leading bits. A partition adds up
the mass it gets, takes a capacity above mass / threshold, and merges the sums into one Misra-Gries summary: beyond
the capacity the (k+1)-th largest count is taken from all, what reaches zero goes. With k counters that costs each
n-gram less than mass / (k + 1), so every one that occurs `threshold` times or more survives. The survivors' hashes are
marked in a bitmap of fixed size, a slice of it per partition.

Second pass. Tasks read the texts again and sum, as strings, the n-grams that the bitmap marks and whose parts it
marks; the shuffled sums are exact, and n-grams that only share a bit with a frequent one drop out by their counts. So
the bitmap's size decides how many rows are shuffled and nothing else.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Occurrences of a phrase, words of the longest one, rows for each language.
THRESHOLD, LONGEST, TOP = 10, 3, 2_000
#: A longer phrase hides a part of it if it makes up this many hundredths of the part's occurrences.
HIDES = 50
#: Bits of the bitmap's places: 32 MB, whatever the input. Occurrences that a partition of hashes is meant for.
BITS, MASS = 28, 1 << 22
#: Bytes of text that are counted at once.
STRETCH = 8 << 20
#: Phrases that are sent at once.
ROWS = 20_000
#: A stretch's texts stand one after the other with this byte, which no text has, between pieces.
CUT = b"\xff"
#: A-Z lower-cased, ends of pieces cut, tabs are spaces.
TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * ODD ^ (b + MIX + (a >> np.uint64(5)))) * MIX
    h ^= h >> np.uint64(29)
    return h * ODD


class Stretch:
    """The words of some texts of one language, and the hashes of their n-grams."""

    def __init__(self, lang: str, texts: list[bytes]):
        ids = defaultdict(count().__next__)
        ids[CUT]  # word 0 is a cut
        parts = []
        for t in texts:  # one after the other, so that the words of one text at a time are held as objects
            words = t.translate(TABLE).replace(CUT, b" " + CUT + b" ").split()
            words.append(CUT)
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.ids = np.concatenate(parts)
        self.words, self.lang = list(ids), lang
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes) of the n-grams, for n from 1: an n-gram's hash is made of its words' hashes in order."""
        at = np.flatnonzero(self.ids)
        h = self.hashes[self.ids[at]]
        for n in range(1, longest + 1):
            yield n, at, h
            on = (at + n < len(self.ids)) & (self.ids[np.minimum(at + n, len(self.ids) - 1)] > 0)
            at = at[on]
            h = _joined(h[on], self.hashes[self.ids[at + n]])

    def text(self, at: int, n: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[at : at + n].tolist()])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """Texts by language, gathered up to STRETCH bytes; a longer text is a stretch of its own."""
    held, size = defaultdict(list), defaultdict(int)
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und").to_pylist()
        for lang, text in zip(langs, batch.column(1).cast(pa.binary())):
            text = text.as_py()
            if text:
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= STRETCH:
                    yield Stretch(lang, held.pop(lang))
                    size.pop(lang)
    for lang, texts in held.items():
        yield Stretch(lang, texts)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[edge], np.add.reduceat(n[order], edge)


def merged(h: np.ndarray, n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of counts by hash; beyond `capacity` of them less what a Misra-Gries summary takes off, which is the third value."""
    if not len(h):
        return h, n, 0
    h, n = _summed(h, n)
    if len(h) <= capacity:
        return h, n, 0
    off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    return h[n > off], n[n > off] - off, off


def _packed(values: np.ndarray) -> bytes:
    """Rising integers as differences, all first bytes, then all second ones and so on, which compresses well."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return d.view(np.uint8).reshape(len(d), -1).T.tobytes()


def _unpacked(blob: pa.Buffer, kind: type) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(kind).ravel(), dtype=kind)


PARTS = pa.schema([("part", pa.int32()), ("later", pa.int32()), ("mass", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _first(batches: Iterator[pa.RecordBatch], parts: int, longest: int) -> Iterator[pa.RecordBatch]:
    """A stretch's sums, dealt to partitions of leading bits: for each one a row with the mass and one with the sums."""
    width = parts.bit_length() - 1
    for stretch in _stretches(batches):
        h = np.concatenate([h for _, _, h in stretch.grams(longest)])
        if not len(h):
            continue
        h.sort()
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(edge, len(h)))
        h = h[edge]
        cuts = np.searchsorted(h >> np.uint64(64 - width), np.arange(parts + 1, dtype=np.uint64)) if width else np.array([0, len(h)])
        total = np.append(0, np.cumsum(n))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[p], cuts[p + 1]
            yield pa.RecordBatch.from_pylist([
                {"part": p, "later": 0, "mass": int(total[b] - total[a])},
                {"part": p, "later": 1, "hashes": _packed(h[a:b]), "counts": _packed(total[a + 1 : b + 1] - total[a])},
            ], PARTS)


def _bits(part: int, parts: int, hashes: np.ndarray, bits: int) -> bytes:
    """The partition's slice of the bitmap, which the leading bits of a hash address."""
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64) - part * ((1 << bits) // parts)
    mask = np.zeros((1 << bits) // parts, bool)
    mask[slot] = True
    return np.packbits(mask).tobytes()


def _summaries(batches: Iterator[pa.RecordBatch], parts: int, threshold: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows by partition, those with masses first: one summary at a time, never more than twice its capacity held."""
    schema = pa.schema([("part", pa.int32()), ("kept", pa.int64()), ("bitmap", pa.binary())])
    part, mass, held, waiting, ahead, off = None, 0, (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0, 0

    def merge():
        nonlocal held, waiting, ahead, off
        *held, more = merged(np.concatenate([held[0], *[x[0] for x in waiting]]), np.concatenate([held[1], *[x[1] for x in waiting]]), mass // threshold + 1)
        waiting, ahead, off = [], 0, off + more

    def out():
        merge()
        likely = held[0][held[1] + off >= threshold]  # what was taken off is the most that a count can lack
        return pa.RecordBatch.from_pylist([{"part": part, "kept": len(likely), "bitmap": _bits(part, parts, likely, bits)}], schema)

    for batch in batches:
        for own, later, more, hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            if own != part:
                if part is not None:
                    yield out()
                part, mass, held, waiting, ahead, off = own, 0, (held[0][:0], held[1][:0]), [], 0, 0
            if later:
                sums = np.diff(_unpacked(counts.as_buffer(), np.int64), prepend=0)
                waiting.append((_unpacked(hashes.as_buffer(), np.uint64), sums))
                ahead += len(sums)
                if ahead > mass // threshold + 1:
                    merge()
            else:
                mass += more
    if part is not None:
        yield out()


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _second(batches: Iterator[pa.RecordBatch], bitmap, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Sums of the marked n-grams of each stretch as strings, and of all its words under an empty phrase."""
    marks = np.frombuffer(bitmap.value, np.uint8)
    shift = np.uint64(64 - bits)
    for stretch in _stretches(batches):
        whole = None
        for n, at, h in stretch.grams(longest):
            if n == 1:
                yield _counted(stretch.lang, [b""], 0, [len(at)])
            slot = (h >> shift).astype(np.int64)
            on = (marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
            if whole is not None:  # both parts that are a word shorter are marked
                on &= whole[at] & whole[at + 1]
            whole = np.zeros(len(stretch.ids) + 1, bool)
            whole[at[on]] = True
            at, h = at[on], h[on]
            order = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(h[order]) != 0)) if len(h) else order
            first, counts = at[order[edge]], np.diff(np.append(edge, len(h)))
            for k in range(0, len(first), ROWS):  # sent as they are made
                yield _counted(stretch.lang, [stretch.text(a, n) for a in first[k : k + ROWS].tolist()], n, counts[k : k + ROWS])


def _counted(lang: str, phrases: list[bytes], n: int, counts: np.ndarray | list[int]) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(phrases), n), pa.int32()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=COUNTED)


def survivors(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, bits: int = BITS, mass: int = MASS) -> bytes:
    """The bitmap of the n-grams that the summaries keep; docs has lang and text only."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << min(bits - 3, max(0, int(size * longest // 5 // mass).bit_length()))  # a word and its blank take five bytes or so; only the load hangs on it
    sums = docs.mapInArrow(lambda it: _first(it, parts, longest), "part int, later int, mass long, hashes binary, counts binary")
    dealt = sums.repartition(parts, "part").sortWithinPartitions("part", "later")
    slices = dealt.mapInArrow(lambda it: _summaries(it, parts, threshold, bits), "part int, kept long, bitmap binary").select("part", "bitmap").collect()  # all slices together are the bitmap of fixed size
    bitmap = bytearray((1 << bits) // 8)
    step = len(bitmap) // parts
    for r in slices:
        bitmap[r.part * step : (r.part + 1) * step] = r.bitmap
    return bytes(bitmap)


def frequent(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, bits: int = BITS, mass: int = MASS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, n): exact counts of all n-grams of up to `longest` words that occur `threshold` times or more in their language, and under an empty phrase of all words."""
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(survivors(docs, threshold, longest, bits, mass))
    sums = docs.mapInArrow(lambda it: _second(it, marks, bits, longest), "lang string, phrase string, words int, n long")
    return sums.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(f"words = 0 OR n >= {int(threshold)}")


def mine(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, bits: int = BITS, mass: int = MASS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    a is the phrase's count, l and r the counts of its parts at the cut with the least floor(1000000 a a / (l r)), n all words of the
    language. Phrases that a longer one with at least half their occurrences contains are left out. Ties in the score go to
    the larger a, then to the lesser phrase by its bytes. A null language is `und`, null and empty texts have no words, repeated rows count
    each; only the language and the text are read, so other columns cannot clash. An empty table gives an empty result. Very long texts are
    counted whole, each as a stretch of its own in about 150 bytes a word. Both passes and the steps between run when this is called.
    """
    from plumbline.llm._shared import stored

    counts = stored(frequent(docs, threshold, longest, bits, mass, lang_col, text_col), "phrases")
    part = lambda x: counts.select("lang", F.col("phrase").alias(x), F.col("n").alias(f"n_{x}"))
    phrases = counts.where("words >= 2").withColumn("w", F.split("phrase", " "))
    cut = phrases.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    cut = cut.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"])
    exact = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    score = F.expr(f"(1000000 * {exact('a')} * {exact('a')}) div ({exact('n_left')} * {exact('n_right')})")
    least = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", F.col("n_left").alias("l"), F.col("n_right").alias("r"))).alias("b"))
    inner = phrases.where("words >= 3").select("lang", F.col("n").alias("by"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "by", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("from"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("by").alias("by"))
    left = least.join(inner, ["lang", "phrase"], "left").where(f"by IS NULL OR 100 * by < {HIDES} * a").select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    few = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(16))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {int(top)}").drop("salt", "rank")
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {int(top)}")
    words = counts.where("words = 0").select("lang", F.col("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
