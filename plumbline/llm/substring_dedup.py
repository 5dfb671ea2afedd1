"""Passages of 50 words that repeat across documents, by prefix-partitioned suffix trees.

Suffixes enter the trees at anchors only: of each 50-word window the 8-word prefix with the least hash, so equal windows
have equal anchors, and about one place in 22 is one. Suffixes are split into groups by that prefix; groups that one
document alone fills are dropped before any text moves. A group that fits in memory becomes a pair of subtrees, one
over what follows the anchor and one over what precedes it, both as sorted arrays with longest common prefixes. A
node of depth 50 - l in the first that shares leaves with a node of depth l in the second is a repeat of 50 words; its
least document is the one that keeps it. A group that does not fit is split by longer prefixes: the 25 words from the
anchor on for windows that hold them, the 25 before it, read backwards, for the others. What still does not fit gets
the 50 words themselves as prefix: then every node is a leaf, of which only the least document is needed, and Spark
sums that before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import join_by_key, rows_out, stored

#: Words of a window, of the shortest prefix and of the longer one, and the places that an anchor can have in its window.
WINDOW, PREFIX, LONGER = 50, 8, 25
PLACES = WINDOW - PREFIX + 1
#: Distinct contexts up to which a group is built in memory; rows that a batch of groups gathers; words looked at in one piece.
GROUP, BATCH, PIECE = 10_000, 10_000, 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
HEAD = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("n_words", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])
INSTANCES = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("content", pa.binary()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, prefix hash, first, last) of each anchor of a text, given its words' hashes: the anchor of all windows that start from first to last."""
    n = len(h)
    if n < WINDOW:
        z = np.empty(0, np.int64)
        return z, z.view(np.uint64), z, z
    g = h[: n - PREFIX + 1].copy()
    for k in range(1, PREFIX):
        g = (g ^ (g >> np.uint64(31))) * MIX + h[k : n - PREFIX + 1 + k]
    g = (g ^ (g >> np.uint64(29))) * MIX
    at = []
    for base in range(0, n - WINDOW + 1, PIECE):
        x = g[base : base + PIECE + PLACES - 1]
        low = (x & ~np.uint64((1 << 21) - 1)) | np.arange(len(x), dtype=np.uint64)  # of equal hashes the first
        width = 1
        while 2 * width <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (PLACES - width)], low[PLACES - width :])
        at.append((low & np.uint64((1 << 21) - 1)).astype(np.int64) + base)
    at = np.concatenate(at)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return at[first], g[at[first]], first, last


def _headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in HEAD}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            joined = b" ".join(words)
            own = np.unique(anchors(_hashes(words))[1]).view(np.int64) if len(words) >= WINDOW else []
            for name, v in zip(out, (doc_id, xxhash.xxh3_128_digest(joined), len(words), hashlib.sha256(joined).hexdigest(), own), strict=True):
                out[name].append(v)
        yield rows_out(out, HEAD)


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, content, text, shared) of joined rows, without those where another text of the same id was joined."""
    for batch in batches:
        doc, text, content, shared = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "content", "shared"))
        own = [xxhash.xxh3_128_digest(b" ".join(t.as_py().encode("utf-8", "surrogatepass").split())) == c.as_py() for t, c in zip(text, content, strict=True)]
        yield pa.RecordBatch.from_arrays([doc, content, text, shared], ["doc_id", "content", "text", "shared"]).filter(pa.array(own))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instances of the shared anchors of each text, with the words around them."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in INSTANCES}
        for doc_id, content, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            at, h, first, last = anchors(_hashes(words))
            keep = np.isin(h.view(np.int64), np.array(shared, np.int64))
            for p, x, a, b in zip(at[keep].tolist(), h[keep].view(np.int64).tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                before, after = b" ".join(words[max(0, p - PLACES + 1) : p]), b" ".join(words[p : p + WINDOW])
                c = np.uint64(xxhash.xxh3_64_intdigest(before + b"\n" + after)).view(np.int64).item()
                for name, v in zip(out, (x, c, doc_id, content, p, p - b, p - a, before, after), strict=True):
                    out[name].append(v)
            if len(out["h"]) > 20_000:
                yield rows_out(out, INSTANCES)
                out = {f.name: [] for f in INSTANCES}
        yield rows_out(out, INSTANCES)


def _tree(group: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of the rows of m within groups, and in that order the longest common prefix with the row before (-1: another group)."""
    order = np.lexsort([*m.T[::-1], group])
    s, g = m[order], group[order]
    same = s[1:] == s[:-1]
    lcp = np.where(same.all(1), m.shape[1], same.argmin(1))
    lcp[g[1:] != g[:-1]] = -1
    return order, np.append(-1, lcp)


def repeats(group: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row a number whose bit l says that the window starting l words before the anchor is also one of a smaller document.

    before: hashes of the words before the anchor, the nearest first; after: from the anchor on. Windows start lo to hi
    words before it.
    """
    n = len(group)
    mask = np.zeros(n, np.int64)
    r_order, r_lcp = _tree(group, after)
    l_order, l_lcp = _tree(group, before)
    r_id, l_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(PLACES):
        # Nodes of the two trees at depths that make 50 words together.
        r_id[r_order] = np.cumsum(r_lcp < WINDOW - back)
        l_id[l_order] = np.cumsum(l_lcp < back)
        rows = np.flatnonzero((lo <= back) & (back <= hi))
        if not len(rows):
            continue
        key = r_id[rows] * (n + 1) + l_id[rows]
        order = np.lexsort((doc[rows], key))
        k, d = key[order], doc[rows][order]
        fresh = np.append(True, k[1:] != k[:-1])
        least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        hit = rows[order[d > least]]
        mask[hit] |= np.int64(1 << back)
    return mask


def _matrix(texts: list[bytes], width: int, nearest_last: bool) -> np.ndarray:
    """Hashes of the words, one text a row; places that a text lacks differ in every row."""
    n = len(texts)
    out = (np.arange(1, n * width + 1, dtype=np.uint64) * MIX).reshape(n, width)
    for i, t in enumerate(texts):
        h = _hashes(t.split())
        if len(h):
            out[i, : len(h)] = h[::-1] if nearest_last else h
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, doc_id, lo, hi, before, after) with `g`, the hash of a longer prefix, once for the windows that hold 25 words from the anchor on and once for those that hold 25 before it."""
    schema = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for h, c, doc, lo, hi, before, after in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            half = WINDOW - LONGER
            for words, a, b, side in ((after.split()[:LONGER], lo, min(hi, half), 1), (before.split()[-LONGER:], max(lo, half + 1), hi, 2)):
                if a <= b:
                    g = np.uint64(xxhash.xxh3_64_intdigest(b"%d %d " % (h, side) + b" ".join(words))).view(np.int64).item()
                    for name, v in zip(out, (g, h, c, doc, a, b, before, after), strict=True):
                        out[name].append(v)
        yield rows_out(out, schema)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, h, c, doc_id, lo, hi, before, after), one for each distinct context, sorted by the group g; whole groups are gathered to batches."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("owner", pa.int64()), ("mask", pa.int64())])
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        g, h, c, doc, lo, hi = (t.column(i).to_numpy() for i in range(6))
        mask = repeats(g, doc, lo, hi, _matrix(t.column(6).to_pylist(), PLACES - 1, True), _matrix(t.column(7).to_pylist(), WINDOW, False))
        return rows_out({"h": h, "c": c, "owner": doc, "mask": mask}, schema)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            t = pa.Table.from_batches(held)
            g = t.column(0).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, doc_id, back, w): every window of the contexts of groups that do not fit, as a prefix of 50 words."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("back", pa.int32()), ("w", pa.binary())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for h, c, doc, lo, hi, before, after in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            left, right = before.split(), after.split()
            for back in range(lo, hi + 1):
                w = left[len(left) - back :] + right[: WINDOW - back]
                for name, v in zip(out, (h, c, doc, back, xxhash.xxh3_128_digest(b" ".join(w))), strict=True):
                    out[name].append(v)
            if len(out["h"]) > 50_000:
                yield rows_out(out, schema)
                out = {f.name: [] for f in schema}
        yield rows_out(out, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, content, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + WINDOW + 1, np.int32)
            for s in spans:
                for back in range(s["lo"], s["hi"] + 1):
                    if s["mask"] >> back & 1:
                        edge[s["at"] - back] += 1
                        edge[s["at"] - back + WINDOW] -= 1
            gone = np.cumsum(edge)[: len(words)] > 0
            kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]).decode("utf-8", "surrogatepass")
            for name, v in zip(out, (doc_id, content, int(gone.sum()), kept), strict=True):
                out[name].append(v)
        yield rows_out(out, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_removed, kept_sha256, and with `with_text` the kept words joined by a space.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null texts have no words; texts of fewer than 50 words lose none. Rows that share a doc_id
    are no smaller than each other and so take nothing from each other; rows with a null id take and lose nothing. An
    empty table gives an empty result. Only the id and the text are read, so other columns cannot clash. Very long
    texts are read whole, in pieces.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    head = stored(d.mapInArrow(_headed, "doc_id long, content binary, n_words long, sha string, anchors array<bigint>"), "heads")
    # Equal texts: the least document stands for all, and its copies lose every word.
    least = head.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL").groupBy("content").agg(F.min("doc_id").alias("least"))
    marked = stored(head.drop("anchors").join(least, "content", "left"), "marked")
    first = head.join(least.withColumnRenamed("least", "doc_id"), ["content", "doc_id"]).select("doc_id", "content", "anchors").dropDuplicates(["doc_id", "content"])
    places = stored(first.select("doc_id", "content", F.explode("anchors").alias("h")), "anchors")
    shared = places.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
    wanted = places.join(shared, "h", "left_semi").groupBy("doc_id", "content").agg(F.collect_list("h").alias("shared"))
    # Texts with shared anchors, once each.
    texts = d.where("text IS NOT NULL AND doc_id IS NOT NULL").join(wanted, "doc_id")
    texts = stored(texts.mapInArrow(_own_text, "doc_id long, content binary, text string, shared array<bigint>"), "texts")
    inst = stored(texts.mapInArrow(_placed, "h long, c long, doc_id long, content binary, at long, lo int, hi int, before binary, after binary"), "instances")

    # Distinct contexts, each with its least document.
    ctx = inst.groupBy("h", "c").agg(F.min(F.struct("doc_id", "lo", "hi", "before", "after")).alias("x")).select("h", "c", "x.*")
    ctx = stored(ctx, "contexts")
    size = ctx.groupBy("h").agg(F.count("*").alias("size"))
    hot = stored(size.where(F.col("size") > GROUP).select("h"), "hot")
    cols = ["h", "c", "doc_id", "lo", "hi", "before", "after"]
    fits = ctx.join(hot, "h", "left_anti").join(size.where("size > 1").select("h"), "h", "left_semi").select(*cols)
    built = lambda df: df.repartition("g").sortWithinPartitions("g").mapInArrow(_built, "h long, c long, owner long, mask long").drop("owner")
    masks = built(fits.select(F.col("h").alias("g"), *cols))
    if not hot.isEmpty():
        longer = stored(ctx.join(hot, "h", "left_semi").select(*cols).mapInArrow(_split, "g long, h long, c long, doc_id long, lo int, hi int, before binary, after binary"), "longer")
        size = longer.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
        huge = stored(size.where(F.col("size") > GROUP).select("g"), "huge")
        masks = masks.unionByName(built(longer.join(huge, "g", "left_anti").join(size.select("g"), "g", "left_semi").select("g", *cols)))
        if not huge.isEmpty():
            w = stored(longer.join(huge, "g", "left_semi").select(*cols).mapInArrow(_windows, "h long, c long, doc_id long, back int, w binary"), "windows")
            low = stored(w.groupBy("h", "w").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1"), "least")
            hit = join_by_key(w, low, ["h", "w"], "n").where("doc_id > low")
            masks = masks.unionByName(hit.select("h", "c", F.expr("shiftleft(1L, back)").alias("mask")).distinct())
    # Each window is in one group, so the bits of a context's rows are different ones.
    masks = masks.groupBy("h", "c").agg(F.sum("mask").alias("mask"))
    # Contexts alone in their group have no mask; a document above a context's owner repeats all its windows.
    owner = ctx.select("h", "c", F.col("doc_id").alias("owner")).join(stored(masks, "masks"), ["h", "c"], "left")
    owner = stored(owner, "owners")
    spans = inst.select("h", "c", "doc_id", "content", "at", "lo", "hi").join(owner, ["h", "c"])
    spans = spans.withColumn("mask", F.when(F.col("doc_id") > F.col("owner"), F.lit(-1).cast("bigint")).otherwise(F.coalesce("mask", F.lit(0).cast("bigint")))).where("mask <> 0")
    spans = spans.groupBy("doc_id", "content").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "lo", "hi", "mask")).alias("spans"))
    cut = texts.select("doc_id", "content", "text").join(spans, ["doc_id", "content"]).mapInArrow(_cut, "doc_id long, content binary, n_removed long, kept_text string")
    sha = F.sha2(F.encode("kept_text", "utf-8"), 256).alias("cut_sha")
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "n_removed", sha, *(["kept_text"] if with_text else [])).dropDuplicates(["_d", "_c"])
    out = marked.join(cut, F.expr("doc_id = _d AND content = _c"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    cols = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        whole = d.select(F.col("doc_id").alias("_w"), F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("words"))
        whole = whole.withColumn("_s", F.sha2(F.encode("words", "utf-8"), 256)).dropDuplicates(["_w", "_s"])
        out = out.join(whole, F.expr("doc_id <=> _w AND sha = _s"), "left")
        cols.append(F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", "words")).alias("kept_text"))
    return out.select(*cols)
