"""Quality rules with a suffix array over each text's words.

A text's suffixes are sorted by their first `LEAST` words, and those that share them with another one further, by
prefix doubling (the others cannot begin a repeat). Neighbours' longest common prefixes are read off the doubling levels; the
larger of a suffix's two is the longest repeat that starts there, and the union of these spans is what repeats. All
texts of a batch are sorted together, in numpy, with the text's number as first key, so no step loops over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import rows_out, slices

#: Words that a repeat needs, to be one.
LEAST = 5
#: A text fails if repeats of at least LONG words cover more than this share of its words. At this value the base rule on
#: repeats of five words contains it; a lower one rejects documents that the labels call good.
LONG, MOST_COVERED = 10, 0.2
#: A text fails if its longest repeat has at least this many words and this share of the text.
LONGEST_WORDS, LONGEST_SHARE = 50, 0.1
#: Limits on the share of symbols in the words' characters, and of repeated lines in the lines.
MOST_SYMBOLS, MOST_DUP_LINES = 0.06, 0.5
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Bytes of a text that are cut into words at once.
PIECE, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")] + [("base_failed", pa.bool_()), ("kept", pa.bool_())])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * MIX
    return h ^ (h >> np.uint64(32))


def _spans_union(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n places are covered by the spans."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _suffix_array(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest repeat at each place whose first `least` words stand twice in its text."""
    n = len(words)
    # All suffixes by text and first words; a rank is the place of the first suffix of its group, so ranks of refined groups stay in order.
    keys = [doc.astype(np.uint64)]
    for k in range(least):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - k] = np.where(doc[: n - k] == doc[k:], words[k:] | np.uint64(1), 0)
        keys.append(ahead)
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(n, bool)
    fresh[0] = True
    for key in keys:
        fresh[1:] |= key[order[1:]] != key[order[:-1]]
    start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = start
    alone = fresh & np.append(fresh[1:], True)
    at = order[~alone].astype(np.int32)
    del keys, order, start, fresh, alone, key, ahead
    if not len(at):
        return at, at
    levels, k = [(least, rank)], least
    while True:
        far = np.minimum(at + k, n)
        own, ahead = rank[at], np.where((far < n) & (doc[np.minimum(far, n - 1)] == doc[at]), rank[far], -1)
        o = np.lexsort((ahead, own))
        at, own, ahead = at[o], own[o], ahead[o]
        group = np.append(True, own[1:] != own[:-1])
        fresh = group | np.append(True, ahead[1:] != ahead[:-1])
        place = np.arange(len(at), dtype=np.int32)
        rank = rank.copy()  # four bytes a word for each level that a repeat reaches
        rank[at] = own + place[fresh][np.cumsum(fresh) - 1] - place[group][np.cumsum(group) - 1]
        if fresh.all():
            break
        k *= 2
        levels.append((k, rank))
    lcp = np.zeros(len(at) - 1, np.int64)  # of neighbours in the suffix array
    a, b = at[:-1], at[1:]
    for step, r in reversed(levels):
        x, y = r[np.minimum(a + lcp, n)], r[np.minimum(b + lcp, n)]
        lcp += np.where((x >= 0) & (x == y), step, 0)
    for _ in range(least - 1):
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += (lcp > 0) & (np.maximum(a, b) + lcp < n) & (words[x] == words[y]) & (doc[x] == doc[a]) & (doc[y] == doc[b])
    return at, np.maximum(np.append(0, lcp), np.append(lcp, 0))


def repeats(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest repeat at every place where one of at least `least` words starts.

    words: hashes of all texts' words one after the other; doc: the text's number, not falling. Repeats are looked
    for within a text only, and may overlap themselves. Texts in which no `least` words stand twice have none and are
    not sorted further.
    """
    n = len(words)
    if n < least + 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = words[: n - least + 1]
    for k in range(1, least):
        gram = _mixed(gram, words[k : n - least + 1 + k])
    at = np.flatnonzero(doc[: n - least + 1] == doc[least - 1 :])
    gram = _mixed(gram[at], doc[at].astype(np.uint64))
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    some = np.zeros(int(doc[-1]) + 1, bool)
    some[doc[at[order[1:]][same]]] = True
    where = np.flatnonzero(some[doc])
    start, length = _suffix_array(words[where], doc[where], least)
    return where[start], length


def _hashed(text: bytes) -> np.ndarray:
    """Hashes of the words; of a very long text a piece at a time, so that its words never stand in memory together."""
    out, start = [np.empty(0, np.uint64)], 0
    while start < len(text):
        stop = start + PIECE
        end = BLANK.search(text, stop)
        stop = end.start() if end else len(text)
        words = text[start:stop].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        start = stop
    return np.concatenate(out)


def measures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """For each text the counts of SCHEMA without doc_id."""
    m = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashed = [_hashed(b) for b in raw]
    n_words = np.fromiter(map(len, hashed), np.int64, m)
    lines = [[x for x in b.split(b"\n") if x.strip(BLANKS)] for b in raw]
    n_lines = np.fromiter(map(len, lines), np.int64, m)
    bare = [b.translate(None, BLANKS) for b in raw]
    n = int(n_words.sum())
    words = np.concatenate(hashed) if n else np.empty(0, np.uint64)
    del hashed
    doc = np.repeat(np.arange(m), n_words)
    at, length = repeats(words, doc)
    per_doc = lambda mask: np.bincount(doc[mask], minlength=m) if n else np.zeros(m, np.int64)
    longest = np.zeros(m, np.int64)
    if len(at):
        np.maximum.at(longest, doc[at], length)
    long = length >= LONG
    return {
        "n_words": n_words,
        "word_chars": np.fromiter((len(b.decode("utf-8", "surrogatepass")) for b in bare), np.int64, m),
        "n_symbols": np.fromiter((len(b) - len(b.translate(None, SYMBOLS)) for b in bare), np.int64, m),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, m),
        "n_repeat_words": per_doc(_spans_union(n, at, np.full(len(at), LEAST))) if n else n_words,
        "n_covered": per_doc(_spans_union(n, at[long], length[long])) if n else n_words,
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """base_failed and kept, from the measures."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    good = (
        (m["n_covered"] <= MOST_COVERED * m["n_words"])
        & ~((m["longest_repeat"] >= LONGEST_WORDS) & (m["longest_repeat"] >= LONGEST_SHARE * m["n_words"]))
        & (m["n_symbols"] <= MOST_SYMBOLS * m["word_chars"])
        & (m["n_dup_lines"] <= MOST_DUP_LINES * m["n_lines"])
    )
    return {"base_failed": failed, "kept": ~failed & good}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column(1)):
            m = measures(texts)
            yield rows_out({"doc_id": batch.column(0).slice(a, b - a), **m, **verdicts(m)}, SCHEMA)


def _passed(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column(text_at)):
            yield batch.slice(a, b - a).filter(pa.array(verdicts(measures(texts))["kept"]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts, `base_failed` and `kept`; no shuffle, each text is judged by itself.

    Null, empty and blank texts have no words and fail (fewer than 10 words). Repeated rows are judged each. Only the
    id and the text are read, so other columns cannot clash. An empty table gives an empty result. Very long texts
    are sorted whole, one at a time, in some hundred bytes a word.
    """
    schema = ", ".join(f"{f.name} {'boolean' if f.name in ('base_failed', 'kept') else 'long'}" for f in SCHEMA)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measured, schema)


def passed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that judge() keeps, with all their columns, whatever their names, in one pass.

    Documents with a null, empty or blank text go, as they have fewer than 10 words; a null id changes nothing.
    Repeated rows stay or go together. An empty table stays empty. Very long texts are judged whole.
    """
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _passed(it, at), docs.schema)
