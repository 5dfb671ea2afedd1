"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: keys fall into small groups, and each group
gets the first seed that sends its keys to free slots). It turns a pre-token that is itself a token into its id by one
probe and one comparison of bytes. Tier two, for the rest: merges from a heap of candidate pairs over a linked list of
parts, O(n log n) in the pre-token's length, so a text without a break costs no more than others.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import rows_out, slices

#: Pre-tokens whose ids a task remembers, and the most characters of one that it remembers, so some 40 MB at most; when full, it stays as it is.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 32
MASK = (1 << 64) - 1
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: slot(key) is below len(keys), and no two keys share one."""

    def __init__(self, keys: list[bytes], per_group: int = 2):
        n = self.n = len(keys)
        self.groups = max(1, n // per_group)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        group = (hashes % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        self.seeds = [0] * self.groups
        taken = bytearray(n)
        free = None
        for g in np.argsort(cuts[:-1] - cuts[1:], kind="stable").tolist():  # the largest first
            own = hashes[order[cuts[g] : cuts[g + 1]]].tolist()
            if not own:
                break
            if len(own) == 1:  # a lone key gets the next free slot by name, as -1 - slot
                free = free or iter([s for s in range(n) if not taken[s]])
                self.seeds[g] = -1 - next(free)
                continue
            seed = 0
            while True:
                slots = {self._at(h, seed) for h in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.seeds[g] = seed
            for s in slots:
                taken[s] = 1

    def _at(self, h: int, seed: int) -> int:
        x = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & MASK
        return (x ^ (x >> 32)) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.groups]
        return -1 - seed if seed < 0 else self._at(h, seed)


class Codec:
    """Ranks of a vocabulary file (a base64 token and its rank a line), and the pattern that cuts texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        self.hash = PerfectHash([k for k, _ in pairs])
        self.key: list[bytes] = [b""] * len(pairs)
        self.rank: list[int] = [0] * len(pairs)
        for k, r in pairs:
            s = self.hash.slot(k)
            self.key[s], self.rank[s] = k, r
        self.bytes_of = {r: k for k, r in pairs}
        self.byte_id = [-1] * 256
        ids = dict(pairs)
        for k, r in pairs:
            if len(k) == 1:
                self.byte_id[k[0]] = r
        self.shift = max(ids.values()).bit_length()
        #: The token that two neighbouring tokens make, by both ids in one number.
        self.pair = {(x << self.shift) | y: r for k, r in pairs for i in range(1, len(k)) if (x := ids.get(k[:i])) is not None and (y := ids.get(k[i:])) is not None}
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def find(self, piece: bytes) -> int:
        """The rank of a token, -1 if there is none."""
        s = self.hash.slot(piece)
        return self.rank[s] if self.key[s] == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, of equal ranks the leftmost."""
        n, pair, shift = len(piece), self.pair.get, self.shift
        ids = list(map(self.byte_id.__getitem__, piece))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r * n + i for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pair(x << shift | y, -1)) >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j == n or pair(ids[i] << shift | ids[j]) != r:
                continue  # one of the two parts has been merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pair(r << shift | ids[k], -1)) >= 0:
                    heappush(heap, q * n + i)
            h = before[i]
            if h >= 0 and (q := pair(ids[h] << shift | r, -1)) >= 0:
                heappush(heap, q * n + h)
        return [x for x in ids if x >= 0]

    def of_piece(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8", "replace")
        r = self.find(raw)
        return array("I", [r] if r >= 0 else self.merged(raw)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a pre-token is looked up once for all of them."""
        cut = [self.cut(t) for t in texts]
        known, piece = self.known, self.of_piece
        own = {p: known[p] if p in known else piece(p) for p in set(chain.from_iterable(cut))}
        if len(known) < REMEMBERED:
            known.update(islice(((p, v) for p, v in own.items() if len(p) <= LONGEST_REMEMBERED and p not in known), REMEMBERED - len(known)))
        return [b"".join(map(own.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _coded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, digest: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path, pattern)
    for batch in batches:
        for a, b, texts in slices(batch.column(1)):
            ids = c.encode([t or "" for t in texts])
            back = [c.decode(x) for x in ids]
            out = {"doc_id": batch.column(0).slice(a, b - a), "n_tokens": [len(x) // 4 for x in ids]}
            if digest:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield rows_out(out | {"ids_sha256": list(map(sha, ids)), "decoded_sha256": list(map(sha, back))}, DIGEST)
            else:
                yield rows_out(out | {"ids": ids, "decoded": back}, SCHEMA)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, and the ids (binary, little-endian unsigned 32-bit) with the bytes that they decode to, or with `digest` the SHA-256 of both.

    path, pattern: vocabulary file, which every executor must have, and cutting pattern. Null texts are empty; an
    empty text has no ids. Strings of special tokens are ordinary text. Repeated rows are coded each. No shuffle:
    a task holds the vocabulary, a bounded memory of pre-tokens and about a million bytes of texts, or one
    longer text. Only the id and the text are read, so other columns cannot clash.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _coded(it, path, pattern, digest), schema)
