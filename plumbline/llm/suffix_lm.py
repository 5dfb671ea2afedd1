"""Language-model scores from a probabilistic suffix tree over words, kept in partitions.

A context is a string of up to `DEPTH` words before a token; the word before a text's first token is the end of another.
Contexts that occur at least `LEAST` times in training texts are candidates, whatever the size of the corpus, and a
candidate is retained if its next-word distribution diverges from what its longest proper suffix gives by more than
chance does. Distributions are smoothed with those of the next shorter retained suffix, down to the unigram model, so
they sum to one. A token is scored in the longest retained suffix of what precedes it.

All strings (context, next word) of candidates are counted over the whole corpus, and nothing of the tree is collected
or broadcast: it grows with the corpus. Texts are put into blocks. Length by length, each block asks once for each of
its strings, with its own count of it; the questions are dealt into buckets of about `BUCKET` tokens by context, a
bucket adds up the counts, tests its contexts and answers each block. A block that has the answers to all shorter
strings knows which contexts are candidates for the next length. Contexts with more than `SPREAD` occurrences are dealt
by string instead, so that no context makes a bucket large; each bucket gives its share of their divergence, and the
shares are added up by context, so that they take the same test. Only the two sums of the unigram model and the hashes
of the contexts dealt by string that are retained, at most one for `SPREAD` tokens and length, come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import rows_out, stored

#: Longest context; least occurrences of a candidate; divergence in nats, beyond what chance gives, from which it is retained; weight of the suffix's distribution, in tokens.
DEPTH, LEAST, DIVERGES, SMOOTH = 3, 2, 0.01, 2.0
#: Documents and characters from which a block is full; tokens a bucket; occurrences from which a context's strings are dealt one by one.
BLOCK_DOCS, BLOCK_CHARS, BUCKET, SPREAD = 3000, 12_000_000, 2_000_000, 1_000_000
#: Documents are held out whose crc32 leaves REST by FOLDS.
FOLDS, REST = 7, 2
#: The end of a text: no word, as words hold no blank.
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))
BLOCKS = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("words", pa.binary())])
ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("contexts", pa.binary()), ("runs", pa.binary()), ("next", pa.binary()), ("n", pa.binary()), ("surprise", pa.binary()), ("spread_at", pa.binary()), ("spread_context", pa.binary()), ("spread_total", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary()), ("total", pa.int64()), ("words", pa.int64()), ("context", pa.list_(pa.int64())), ("gain", pa.list_(pa.int64())), ("distinct", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
ASKED_SQL = "block long, bucket long, contexts binary, runs binary, next binary, n binary, surprise binary, spread_at binary, spread_context binary, spread_total binary"
ANSWERED_SQL = "block long, bucket long, found binary, total long, words long, context array<bigint>, gain array<bigint>, distinct array<bigint>, whole array<bigint>"
#: Shares of a context's divergence are added in whole units of this many to a nat, in any order with the same sum.
UNITS = 1 << 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == REST


def _hashes(words: bytes) -> np.ndarray:
    """Hashes of the words of a text, and its end."""
    own = words.split()
    out = np.empty(len(own) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    out[-1] = END
    return out


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of a context and the next word."""
    h = context * np.uint64(0x9E3779B97F4A7C15) + word
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _packed(x: np.ndarray) -> bytes:
    """Bytes of the same place next to each other, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a block: its documents, the hashes of its words, the commonest first, and each token's place among them."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        chars = 0

        def full() -> pa.RecordBatch:
            lengths = [len(x) for _, x in docs]
            words, ids, n = np.unique(np.concatenate([x for _, x in docs]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            return rows_out({
                "block": [(part << 24) + number], "n_tokens": [sum(lengths)], "doc_id": [[d for d, _ in docs]], "held_out": [[held_out(d) for d, _ in docs]], "lengths": [lengths],
                "ids": [_packed(place[ids])], "words": [words[order].tobytes()],
            }, BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                docs.append((doc_id, _hashes(words)))
                chars += len(words)
                if len(docs) >= most or chars >= BLOCK_CHARS:
                    yield full()
                    docs, chars, number = [], 0, number + 1
        if docs:
            yield full()

    return blocks


class Block:
    """A block's tokens, and the strings that it asks for."""

    def __init__(self, row: dict):
        self.row = row
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        self.words = words[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = place[_unpacked(row["ids"], np.uint32)]
        lengths = np.array(row["lengths"], np.int64)
        self.start = np.append(0, np.cumsum(lengths)[:-1])
        self.train = np.repeat(~np.array(row["held_out"], bool), lengths)

    def unigrams(self) -> tuple:
        """What is asked first: words, which are contexts of nothing."""
        n = np.bincount(self.ids, weights=self.train, minlength=len(self.words))
        return self.words, np.zeros(0, np.uint64), n, np.zeros(0, np.float16), np.zeros(len(n), bool), self.words, n

    def walk(self, answers: list[np.ndarray], total: int, words: int, dealt: int, spread: float, kept_dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """Goes through the lengths that are answered, each in the order of what its strings were dealt by. Returns the base and the model's probability of each token and what is to be asked next: (key to deal by, next word, count, surprise, whether dealt by string, context, its occurrences) of each string. Of the contexts dealt by string (over `dealt` occurrences) those in kept_dealt are retained, and all with over `spread`."""
        ids, count = self.ids, answers[0]
        base = (count[ids] + 1.0) / (total + words + 1)
        p = base.copy()
        ctx = np.empty(len(ids), np.int64)  # each token's context as a place among the strings asked before
        ctx[1:] = ids[:-1]
        ctx[self.start] = np.searchsorted(self.words, END)
        hashes = self.words
        for length in range(1, DEPTH + 1):
            on = np.flatnonzero(ctx >= 0)
            on = on[count[ctx[on]] >= LEAST]
            own, at = np.unique(ctx[on], return_inverse=True)
            order = np.argsort(hashes[own])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            h, total_of = hashes[own][order], count[own][order]
            code, first, string = np.unique(place[at] * len(self.words) + ids[on], return_index=True, return_inverse=True)
            c, word = code // len(self.words), self.words[code % len(self.words)]
            strings, n_ctx = _mix(h[c], word), total_of[c]
            hot = n_ctx > dealt
            keys = np.where(hot, strings, h[c])
            if length == len(answers):
                surprise = (-np.log(p[on][first])).astype(np.float16)
                return base, p, (keys, word, np.bincount(string, weights=self.train[on], minlength=len(code)), surprise, hot, h[c], n_ctx)
            found = np.empty(len(code), np.int64)
            found[_order(keys)] = answers[length]
            n, kept = found >> 1, (n_ctx > spread) | np.where(hot, np.isin(h, kept_dealt)[c], (found & 1) == 1)
            p[on] = np.where(kept[string], (n[string] + SMOOTH * p[on]) / (n_ctx[string] + SMOOTH), p[on])
            longer = np.full(len(ids), -1, np.int64)
            longer[on] = string
            ctx[1:] = longer[:-1]  # the string that ends one token back is the context one word longer
            ctx[self.start] = -1
            hashes, count = strings, n
        return base, p, None


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable")


def _questions(block: int, asked: tuple, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a block's questions by bucket, in the order of what they are dealt by."""
    keys, word, n, surprise, hot, context, total = asked
    order = _order(keys)
    keys, n = keys[order], n[order].astype(np.uint32)
    bucket = (keys >> np.uint64(63 - bits)) >> np.uint64(1)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(keys)), strict=True):
        if a == b:
            continue
        new = np.append(0, np.flatnonzero(np.diff(keys[a:b])) + 1)
        runs = np.diff(np.append(new, b - a)).astype(np.uint32)
        some = order[a:b]
        # A next word is told by 32 bits beside its context's 64: of the at most `SPREAD` in a context, about one in 10,000 is taken for another at worst.
        nexts = (word[some] >> np.uint64(32)).astype(np.uint32).tobytes() if len(word) else None
        at = np.flatnonzero(hot[some])
        of_spread = [_packed(at.astype(np.uint32)), _packed(context[some[at]]), _packed(total[some[at]].astype(np.uint64))] if len(at) else [None] * 3
        yield rows_out({"block": [block], "bucket": [int(bucket[a])], "contexts": [_packed(np.diff(keys[a:b][new], prepend=np.uint64(0)))], "runs": [_packed(runs)], "next": [nexts], "n": [_packed(n[a:b])], "surprise": [_packed(surprise[some]) if len(word) else None], **{k: [x] for k, x in zip(("spread_at", "spread_context", "spread_total"), of_spread)}}, ASKED)


def _shares(asked: pa.Table, sizes: list[int], string: np.ndarray, found: np.ndarray, surprise: np.ndarray) -> list[np.ndarray] | None:
    """The contexts dealt by string that a bucket has strings of, with its share of their divergence in UNITS, how many of their next words it has, and their occurrences."""
    some = [(start, *x) for start, *x in zip(np.cumsum([0, *sizes[:-1]]), *(asked.column(c).to_pylist() for c in ("spread_at", "spread_context", "spread_total"))) if x[0] is not None]
    if not some:
        return None
    at = string[np.concatenate([start + _unpacked(x, np.uint32).astype(np.int64) for start, x, _, _ in some])]
    at, first = np.unique(at, return_index=True)
    context, whole = (np.concatenate([_unpacked(x[k], np.uint64) for x in some])[first] for k in (2, 3))
    gain = np.round(found[at] * (np.log(np.maximum(found[at], 1) / whole) + surprise[at]) * UNITS).astype(np.int64)
    context, first, own = np.unique(context, return_index=True, return_inverse=True)
    sums = np.zeros((2, len(context)), np.int64)
    np.add.at(sums[0], own, gain)
    np.add.at(sums[1], own, found[at] > 0)
    return [context.view(np.int64), *sums, whole[first].astype(np.int64)]


def _answer(asked: pa.Table) -> pa.Table:
    """The counts of a bucket's strings for each block that asks: twice the count, plus one if the context is retained; for words the count alone, and a row of sums without a block; of contexts dealt by string a row of shares without a block."""
    contexts = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in asked.column("contexts").to_pylist()]
    runs = [_unpacked(x, np.uint32) for x in asked.column("runs").to_pylist()]
    sizes = [int(x.sum()) for x in runs]
    n = np.concatenate([_unpacked(x, np.uint32) for x in asked.column("n").to_pylist()]).astype(np.float64)
    own, at = np.unique(np.concatenate(contexts), return_inverse=True)
    ctx = np.repeat(at, np.concatenate(runs))
    nexts = asked.column("next").to_pylist()
    sums: list = []
    shares = None
    if nexts[0] is None:
        found = np.bincount(ctx, weights=n, minlength=len(own)).astype(np.uint64)
        sums = [int(found.sum()), int((found > 0).sum())]
        values = found[ctx]
    else:
        word = np.concatenate([np.frombuffer(x, np.uint32) for x in nexts]).astype(np.uint64)
        _, first, string = np.unique(_mix(own[ctx], word), return_index=True, return_inverse=True)
        found = np.bincount(string, weights=n)
        surprise = np.concatenate([_unpacked(x, np.float16) for x in asked.column("surprise").to_pylist()])[first].astype(np.float64)
        c = ctx[first]
        whole = np.maximum(np.bincount(c, weights=found, minlength=len(own)), 1)
        gain = found * (np.log(np.maximum(found, 1) / whole[c]) + surprise)
        gain = np.bincount(c, weights=gain, minlength=len(own))
        distinct = np.bincount(c, weights=found > 0, minlength=len(own))
        retained = gain - distinct / 2 >= DIVERGES * whole
        values = (found.astype(np.uint64) * np.uint64(2) + retained[c].astype(np.uint64))[string]
        shares = _shares(asked, sizes, string, found, surprise)
    cuts = np.cumsum(sizes)[:-1]
    rows = {"block": asked.column("block").to_pylist(), "bucket": asked.column("bucket").to_pylist(), "found": [_packed(x) for x in np.split(values, cuts)]}
    rows |= {name: [None] * len(sizes) for name in ANSWERED.names[3:]}
    if sums or shares:
        for name, value in zip(rows, [None, rows["bucket"][0], None, *(sums or [None] * 2), *(shares or [None] * 4)], strict=True):
            rows[name].append(value)
    return pa.Table.from_batches([rows_out(rows, ANSWERED)])


def _answered(block: Block, answers: pa.Table, lengths: int, total: int, words: int, dealt: int, spread: float, kept_dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    by: list[list] = [[] for _ in range(lengths)]
    for length, bucket, found in zip(answers.column("length").to_pylist(), answers.column("bucket").to_pylist(), answers.column("found").to_pylist(), strict=True):
        by[length].append((bucket, found))
    own = [np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x, np.uint64) for _, x in sorted(parts))]).astype(np.int64) for parts in by]
    return block.walk(own, total, words, dealt, spread, kept_dealt)


def _first(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _questions(row["block"], Block(row).unigrams(), bits)

    return ask


def _next(bits: int, *model: float | np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        asked = _answered(Block(row), answers, *model)[2]
        return pa.Table.from_batches(list(_questions(row["block"], asked, bits)), schema=ASKED)

    return ask


def _last(lengths: int, total: int, *model: float | np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        block = Block(row)
        base, p, _ = _answered(block, answers, lengths, total, *model)
        known = base > 1.5 / (total + model[0] + 1)  # an unknown word has 1 there, a known one 2 at least
        out = {
            "doc_id": row["doc_id"], "held_out": row["held_out"], "n_tokens": row["lengths"], "n_known": np.add.reduceat(known.astype(np.int64), block.start), "train_tokens": [total] * len(block.start),
            "base_score": np.add.reduceat(np.log10(base), block.start), "score": np.add.reduceat(np.log10(p), block.start),
        }
        return pa.Table.from_batches([rows_out(out, SCORED)])

    return score


def _step(df: DataFrame, name: str) -> DataFrame:
    """stored(), after which the step's shuffle files are removed, as nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def _retained(found: DataFrame) -> np.ndarray:
    """The hashes of the contexts dealt by string that the divergence test retains, from the buckets' shares."""
    each = found.where("context IS NOT NULL").select(F.explode(F.arrays_zip("context", "gain", "distinct", "whole")).alias("x")).select("x.*")
    each = each.groupBy("context").agg(F.sum("gain").alias("gain"), F.sum("distinct").alias("distinct"), F.max("whole").alias("whole"))
    kept = each.where(F.col("gain") / UNITS - F.col("distinct") / 2 >= DIVERGES * F.col("whole")).select("context").collect()  # at most one for `SPREAD` tokens
    return np.array([r.context for r in kept], np.int64).view(np.uint64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int | None = None, block_docs: int = BLOCK_DOCS, dealt: int = SPREAD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the words, A-Z lower-cased, and one end. Documents with crc32(doc_id as text) mod 7 = 2 are held out of
    the counts; a null id counts as empty text. Null texts are empty: their only token is the end. Repeated rows are
    counted and scored each. An empty table gives an empty result; without training texts all probabilities are those
    of unknown words. Only the id and the text are read, so other columns cannot clash. A very long text is a block
    of its own. Words and strings are known by 64-bit hashes. Planning runs two jobs for each length of context.
    Contexts with more than `dealt` occurrences are dealt by string, which changes no result. `spread`, if given, retains
    contexts with more occurrences than that without a test.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(d.mapInArrow(_blocks(block_docs), "block long, n_tokens long, doc_id array<bigint>, held_out array<boolean>, lengths array<bigint>, ids binary, words binary"), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(3, int(tokens // BUCKET).bit_length())
    asked = blocks.mapInArrow(_first(bits), ASKED_SQL)
    total = words = 0
    most = float("inf") if spread is None else spread
    kept_dealt = np.zeros(0, np.uint64)
    answers: DataFrame | None = None
    for length in range(DEPTH + 1):
        found = _step(asked.groupBy("bucket").applyInArrow(_answer, ANSWERED_SQL), "answers")
        if length == 0:
            total, words = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        else:
            kept_dealt = np.append(kept_dealt, _retained(found))
        own = found.where("block IS NOT NULL").select("block", F.lit(length).alias("length"), "bucket", "found")
        answers = own if answers is None else answers.unionByName(own)
        both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
        if length < DEPTH:
            asked = both.applyInArrow(_next(bits, length + 1, total, words, dealt, most, kept_dealt), ASKED_SQL)
    return both.applyInArrow(_last(DEPTH + 1, total, words, dealt, most, kept_dealt), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
