"""Near-duplicate documents by a chosen-path set similarity join.

Texts that are equal as word sequences become one class at once. In each of several independent trees, a class falls
into the child that its minwise token for that tree names; a child is a node of the next level. The classes of small
nodes are compared exhaustively by sketch; large ones branch again, on tokens that the node's path chooses, as
long as their classes are in different clusters, and what is still large at the last level is compared in blocks,
whole. A pair at the threshold takes the same branch with the probability of its similarity, so with `TREES` trees at
least 1 - 0.25 ** TREES of the pairs meet at the first level.

No step lists the pairs of a group: a node gives a spanning forest of its similar pairs, and forests make clusters. The
forests' pairs are confirmed on full shingle sets first, which turns a group of near copies into a component with
about one link per member. Where a cluster still has several components, its texts come together once, in blocks,
and pairs between components are confirmed there until no similar pair is left that could join two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import join_by_key, rows_out, stored
from plumbline.operators.graph import components

#: Words in a shingle; the threshold as 100 * intersection >= SIMILAR * union.
SHINGLE, SIMILAR = 5, 75
#: Independent trees; bytes of a sketch (one for each minwise hash); branches and levels of large nodes.
TREES, SKETCH, BRANCHES, LEVELS = 12, 96, 2, 4
#: Rows of a block and the shingles that its texts have together; comparisons and rows that a node may have to be compared whole.
BLOCK, BLOCK_SHINGLES, MOST_WORK, MOST_ROWS = 1000, 1_000_000, 4_000_000, 100_000
#: Least sketch agreement of a pair to be confirmed: four and a half standard deviations below the threshold.
AGREE = 0.75 - 4.5 * (0.75 * 0.25 / SKETCH) ** 0.5

_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 2**63, SKETCH + TREES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SKETCH + TREES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
HASHED = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of 5-word shingles as sorted distinct 64-bit hashes; fewer words count as one shingle, none as none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[k : n + k]
    return np.unique(out)


def words_lower(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, only A-Z have lower-case forms


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in HASHED}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_lower(text.as_py())
            s = shingles(words)
            if len(s):
                low = np.full(SKETCH + TREES, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 4096):  # very long texts in parts
                    x = s[i : i + 4096, None] * _MUL + _ADD
                    x ^= x >> np.uint64(32)
                    x *= MIX
                    np.minimum(low, x.min(0), out=low)
                tokens, sketch = low[SKETCH:].view(np.int64).tolist(), (low[:SKETCH] >> np.uint64(20)).astype(np.uint8).tobytes()
            else:
                tokens, sketch = [], b""
            for name, v in zip(out, (doc_id, xxhash.xxh3_128_digest(b" ".join(words)), len(s), tokens, sketch), strict=True):
                out[name].append(v)
        yield rows_out(out, HASHED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns after `grp` of each run of equal `grp`, sketches as a matrix, texts as Arrow values; rows come sorted by it."""
    held: list[tuple] = []
    now = None

    def made() -> tuple:
        cls, comp, n, sk, *rest = zip(*held, strict=True)
        return (*map(np.concatenate, (cls, comp, n, sk)), *([t for part in x for t in part] for x in rest))

    for batch in batches:
        if not batch.num_rows:
            continue
        grp, cls, comp, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sk = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)
        cuts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])).tolist() + [len(grp)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if grp[a] != now:
                if held:
                    yield made()
                held, now = [], grp[a]
            held.append((cls[a:b], comp[a:b], n[a:b], sk[a:b], *(batch.column(i).slice(a, b - a) for i in range(5, batch.num_columns))))
    if held:
        yield made()


def _similar(comp: np.ndarray, n: np.ndarray, sk: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of rows in different components that sizes and sketches let pass, the most similar first."""
    # Rows of the largest component come last: they need no comparison with each other.
    _, own, count = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.argsort(count[own] == count.max(), kind="stable") if (count == count.max()).sum() == 1 else np.arange(len(n))
    comp, n, sk = comp[order], n[order], sk[order]
    m, first = len(n), int((count[own] != count.max()).sum()) if (count == count.max()).sum() == 1 else len(n)
    found = [np.empty((3, 0), np.int64)]
    step = max(1, 12_000_000 // (SKETCH * m))
    for a in range(0, first, step):
        b = min(first, a + step)
        agree = (sk[a:b, None, :] == sk[None, a:, :]).sum(2, dtype=np.int16)
        lo, hi = np.minimum(n[a:b, None], n[None, a:]), np.maximum(n[a:b, None], n[None, a:])
        i, j = np.nonzero((agree >= AGREE * SKETCH) & (100 * lo >= SIMILAR * hi) & (comp[a:b, None] != comp[None, a:]))
        i, j, agree = i[i < j], j[i < j], agree[i[i < j], j[i < j]]
        found.append(np.stack([order[i + a], order[j + a], agree]))
    i, j, agree = np.concatenate(found, 1)
    best = np.argsort(-agree, kind="stable")
    return i[best].tolist(), j[best].tolist()


class _Forest:
    """Which rows are joined, starting from their components."""

    def __init__(self, comp: np.ndarray):
        _, first, own = np.unique(comp, return_index=True, return_inverse=True)
        self.root = first[own].tolist()

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.root[self.top(x)] = self.top(y)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each group's similar pairs."""
    for cls, comp, n, sk in _groups(batches):
        forest, out = _Forest(comp), []
        for i, j in zip(*_similar(comp, n, sk), strict=True):
            if forest.top(i) != forest.top(j):
                forest.join(i, j)
                out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        if out:
            yield rows_out(dict(zip("ab", zip(*out, strict=True), strict=True)), PAIRS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components of each group, on full sets.

    An inverted list of each shingle gives a row's intersections with all rows at once, so texts that are close to the
    threshold but below it cost no more than others.
    """
    for cls, comp, _, _, texts in _groups(batches):
        m = len(cls)
        sets = [shingles(words_lower(t.as_py())) for t in texts]
        size = np.fromiter(map(len, sets), np.int64, m)
        owner = np.repeat(np.arange(m), size)
        every, at = np.unique(np.concatenate(sets), return_inverse=True)
        owners = owner[np.argsort(at, kind="stable")]  # rows by shingle
        first = np.append(0, np.cumsum(np.bincount(at, minlength=len(every))))
        cut = np.append(0, np.cumsum(size))
        values, own, count = np.unique(comp, return_inverse=True, return_counts=True)
        largest = own == count.argmax()
        forest, out = _Forest(comp), []
        for i in np.flatnonzero(~largest).tolist():
            mine = at[cut[i] : cut[i + 1]]
            start, length = first[mine], first[mine + 1] - first[mine]
            places = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            both = np.bincount(owners[places], minlength=m)
            for j in np.flatnonzero((100 * both >= SIMILAR * (size[i] + size - both)) & (comp != comp[i])).tolist():
                if forest.top(i) != forest.top(j):
                    forest.join(i, j)
                    out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        if out:
            yield rows_out(dict(zip("ab", zip(*out, strict=True), strict=True)), PAIRS)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _grouped(rows: DataFrame, of, *more: str) -> DataFrame:
    dealt = rows.select("grp", "cls", "comp", "n", "sketch", *more).repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(of, "a long, b long").where("a <> b").distinct()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for batch in batches:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, own = a, shingles(words_lower(ta.as_py()))
            if _linked(own, shingles(words_lower(tb.as_py()))):
                out["a"].append(a)
                out["b"].append(b)
        yield rows_out(out, PAIRS)


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that hold on full sets; each pair carries its second text to its first."""
    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirmed, "a long, b long").distinct()


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes (cls, n, sketch) with `comp`, their component in found (id, component)."""
    return classes.join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def _nodes(classes: DataFrame) -> DataFrame:
    """(node, cls, size): the trees' first level, without nodes of one class."""
    first = classes.select("cls", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "cls")
    return join_by_key(first, stored(first.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node-sizes"), ["node"], "size")


def _near(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Forests (a, b) of the nodes' similar pairs. Large nodes are cut into blocks that share their least class."""
    blocks = F.ceil(F.col("size") / BLOCK)
    cut = nodes.select("node", "cls", F.pmod(F.xxhash64("cls"), blocks).alias("block"))
    hubs = nodes.where(F.col("size") > BLOCK).groupBy("node").agg(F.min("cls").alias("cls"), F.first("size").alias("size")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cut = cut.unionByName(hubs.select("node", "cls", "block")).distinct()
    sketches = classes.select("cls", "n", "sketch", F.col("cls").alias("comp"))
    return _grouped(cut.select(F.xxhash64("node", "block").alias("grp"), "cls").join(sketches, "cls"), _forests)


def _apart(nodes: DataFrame, labelled: DataFrame) -> DataFrame | None:
    """Similar pairs (a, b) of different components that the blocks of a large node kept apart; None if no node is large."""
    level = nodes.where(F.col("size") > BLOCK).select("node", "cls")
    if level.isEmpty():
        return None
    level = level.join(labelled, "cls")
    work = None
    for depth in range(LEVELS + 1):
        per = level.groupBy("node", "comp").agg(F.count("*").alias("k")).groupBy("node").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("comps")).where("comps > 1")
        level = stored(level.join(per.withColumn("work", F.col("size") * F.col("size") - F.col("same")).select("node", "size", "work"), "node"), "level")
        small = (F.col("work") <= MOST_WORK) & (F.col("size") <= MOST_ROWS)
        now = level.where(small).select(F.col("node").alias("grp"), "cls", "comp", "n", "sketch")
        work = now if work is None else work.unionByName(now)
        large = level.where(~small).drop("size", "work")
        if large.isEmpty():
            break
        if depth == LEVELS:
            work = work.unionByName(_cells(large.withColumnRenamed("node", "key")))  # the exact way for the rest
            break
        which = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SKETCH)).cast("int") for k in range(BRANCHES)])).alias("at")
        level = large.select("*", which).withColumn("node", F.xxhash64("node", "at", F.expr("substring(sketch, at + 1, 1)"))).drop("at").distinct()
    return _grouped(work, _forests)


def _cells(rows: DataFrame) -> DataFrame:
    """rows (key, cls, comp, ...) by `grp`, groups of at most about two blocks in which any two rows of a key in different components meet.

    The key's largest component is cut into blocks, and so is the rest; each block of the one meets each of the other,
    and blocks of the rest meet each other. Rows of the largest component never meet for their own sake.
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("held"))
    per = per.groupBy("key").agg(F.max(F.struct("k", "comp", "held")).alias("most"), F.sum("k").alias("all"), F.sum("held").alias("held"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda k, held: F.greatest(F.ceil(k / BLOCK), F.ceil(held / BLOCK_SHINGLES))
    per = per.select("key", F.col("most.comp").alias("_most"), blocks(F.col("most.k"), F.col("most.held")).alias("_gb"), blocks(F.col("all") - F.col("most.k"), F.col("held") - F.col("most.held")).alias("_rb"))
    x = rows.join(per, "key").withColumn("_in", F.col("comp") == F.col("_most"))
    x = x.withColumn("_b", F.pmod(F.xxhash64("cls"), F.when(F.col("_in"), F.col("_gb")).otherwise(F.col("_rb"))))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    mine = F.transform(every("_rb"), lambda j: F.xxhash64("key", F.lit("g"), F.col("_b"), j))
    theirs = F.concat(
        F.transform(every("_gb"), lambda i: F.xxhash64("key", F.lit("g"), i, F.col("_b"))),
        F.transform(F.filter(every("_rb"), lambda j: j != F.col("_b")), lambda j: F.xxhash64("key", F.lit("r"), F.least(j, F.col("_b")), F.greatest(j, F.col("_b")))),
    )
    return x.withColumn("grp", F.explode(F.when(F.col("_in"), mine).otherwise(theirs))).select("grp", "cls", "comp", "n", "sketch")


def components_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component) of the classes (cls, n, tokens, sketch) that confirmed links reach."""
    nodes = stored(_nodes(classes), "nodes")
    pairs = stored(_near(nodes, classes), "forests")
    met = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(docs.join(met, "doc_id", "left_semi"), "texts")
    first = stored(components(_confirm(pairs, texts)), "first")
    labelled = stored(_labelled(classes.select("cls", "n", "sketch"), first), "labelled")
    more = _apart(nodes, labelled)
    if more is not None:
        more = stored(more, "apart")
        pairs = pairs.unionByName(more)
        rest = more.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(met, "doc_id", "left_anti")
        texts = texts.unionByName(docs.join(rest, "doc_id", "left_semi"))
    clusters = components(pairs)
    cells = _cells(labelled.join(clusters.select(F.col("id").alias("cls"), F.col("component").alias("key")), "cls"))
    joined = stored(_grouped(cells.join(texts.select(F.col("doc_id").alias("cls"), "text"), "cls"), _joined, "text"), "joined")
    if joined.isEmpty():
        return first
    # The new links join components, of which there are far fewer than classes.
    comp = labelled.select("cls", "comp")
    lifted = joined.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("comp"), F.col("component").alias("merged"))
    return comp.join(merged, "comp", "left").select(F.col("cls").alias("id"), F.coalesce("merged", "comp").alias("component"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of 5-word shingles (A-Z lower-cased; fewer words are one shingle) have
    100 * intersection >= 75 * union; component_id is the least doc_id that links reach, and that document is kept.
    Null, empty and blank texts have no shingles and link with nothing. Repeated rows stay, with the same result.
    Rows with a null id keep their row and are no part of a component. An empty table gives an empty result. Only the
    id and the text are read, so other columns cannot clash. Very long texts are hashed in parts.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = stored(d.mapInArrow(_hashed, "doc_id long, content binary, n long, tokens array<bigint>, sketch binary"), "hashed")
    some = hashed.where("n > 0 AND doc_id IS NOT NULL")
    members = stored(some.groupBy("content").agg(F.min("doc_id").alias("cls")), "classes")
    # A class's tokens are those of its least document, so only that row's are read.
    classes = stored(some.join(members.select(F.col("cls").alias("doc_id"), F.col("content").alias("_c")), "doc_id").where("content = _c").select(F.col("doc_id").alias("cls"), "n", "tokens", "sketch").dropDuplicates(["cls"]), "least")
    found = components_of(classes, d).withColumnRenamed("id", "cls")
    of = members.join(found, "cls", "left").select("content", F.coalesce("component", "cls").alias("component_id"))
    rest = hashed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n", "content").join(of, "content").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest)
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
