"""Quality classifier: a convolutional network over bytes, in numpy.

A byte is a learned vector, a filter a learned pattern of WIDTH bytes that is tried at every second place. A text is
covered from its first to its last byte by chunks of two halves that overlap by one half; each filter counts with its
largest answer in a chunk, a small layer turns a chunk's answers into features, and the largest and the mean of each
feature over all chunks make one probability. Spark scores texts where they are read; the network is some ten kilobytes.

It learns on the driver from a bounded sample: at most SAMPLE labelled texts of at most LONGEST bytes, half of each
class as far as there are any, those with the least hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._shared import unused

#: Labelled texts and bytes of one that the network may learn from; together at most 7 MB.
SAMPLE, LONGEST = 1_800, 4_000
#: Bytes of half a chunk, of a filter, and between the places of a filter.
HALF, WIDTH, STRIDE = 96, 8, 2
VECTOR, FILTERS, FEATURES = 8, 32, 16
#: Of the good texts that it learns from this share is cut to at most so many bytes, anew each time, as few whole texts are as short.
CUT_SHARE, CUT_BYTES = 0.15, 200
STEPS, BATCH, RATE, SEED = 560, 32, 0.004, 13
#: Bytes of text that are scored at once, and filter places at once.
AT_ONCE, PLACES = 4 << 20, 1 << 14
PAD = 256


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each filled up to whole halves with room for a filter's last places, the number of halves of each, and how full each half is."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts])
    out = np.full(int(halves.sum()) * HALF + WIDTH, PAD, np.int16)
    full, at = np.ones(int(halves.sum()), np.float32), 0
    for t, n in zip(texts, halves.tolist()):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
        full[at // HALF - 1] = max(0, len(t) / HALF - (n - 1))
    return out, halves, full


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        self.p = {
            "bytes": normal(257, VECTOR, by=1), "filters": normal(WIDTH * VECTOR, FILTERS, by=WIDTH * VECTOR / 2), "filter_bias": np.zeros(FILTERS, np.float32),
            "features": normal(FILTERS + 1, FEATURES, by=FILTERS / 2), "feature_bias": np.zeros(FEATURES, np.float32), "out": normal(2 * FEATURES, by=2 * FEATURES), "out_bias": np.zeros(1, np.float32),
        }
        self.p["bytes"][PAD] = 0

    def _halves(self, laid: np.ndarray, halves: np.ndarray, learning: bool = False):
        """Each filter's largest answer in each half: (n, FILTERS), and where it was if that is asked for; places from which a filter would reach the next text do not count."""
        n, last = int(halves.sum()), np.zeros(int(halves.sum()), bool)
        last[np.cumsum(halves) - 1] = True
        windows = np.lib.stride_tricks.sliding_window_view(laid, WIDTH)[: n * HALF : STRIDE]
        per = HALF // STRIDE
        best, where, step = np.empty((n, FILTERS), self.p["filters"].dtype), np.empty((n, FILTERS), np.int64), max(1, PLACES // per)
        for k in range(0, n, step):
            part = windows[k * per : (k + step) * per]
            answers = (self.p["bytes"][part].reshape(len(part), -1) @ self.p["filters"]).reshape(-1, per, FILTERS)
            answers[last[k : k + step], 1 - WIDTH // STRIDE :] = -np.inf
            if learning:
                where[k : k + step] = answers.argmax(1)
            best[k : k + step] = answers.max(1)
        return np.maximum(best + self.p["filter_bias"], 0), where, windows

    @staticmethod
    def _chunks(best: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half, second half, chunks of each text): neighbours within a text; a text of one half is one chunk."""
        end = np.cumsum(halves)
        first = np.ones(len(best), bool)
        first[(end - 1)[halves > 1]] = False
        a = np.flatnonzero(first)
        second = np.ones(len(best), np.int64)
        second[(end - 1)[halves == 1]] = 0
        return a, a + second[a], np.maximum(halves - 1, 1)

    def logits(self, laid: np.ndarray, halves: np.ndarray, full: np.ndarray) -> np.ndarray:
        return self._forward(laid, halves, full)[0]

    def _forward(self, laid: np.ndarray, halves: np.ndarray, full: np.ndarray, learning: bool = False):
        best, where, windows = self._halves(laid, halves, learning)
        a, b, chunks = self._chunks(best, halves)
        pooled = np.concatenate([np.maximum(best[a], best[b]), np.where(a == b, full[a], full[a] + full[b])[:, None]], 1)
        feats = np.maximum(pooled @ self.p["features"] + self.p["feature_bias"], 0)
        start = np.append(0, np.cumsum(chunks))[:-1]
        doc = np.concatenate([np.maximum.reduceat(feats, start), np.add.reduceat(feats, start) / chunks[:, None].astype(np.float32)], 1)
        return doc @ self.p["out"] + self.p["out_bias"][0], best, where, windows, a, b, chunks, start, pooled, feats, doc

    def gradients(self, laid: np.ndarray, halves: np.ndarray, full: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by the chain rule from the end to the bytes."""
        logit, best, where, windows, a, b, chunks, start, pooled, feats, doc = self._forward(laid, halves, full, True)
        owner = np.repeat(np.arange(len(halves)), chunks)
        up = ((1 / (1 + np.exp(-logit)) - label) * weight / len(label)).astype(np.float32)
        g = {"out": doc.T @ up, "out_bias": up.sum(keepdims=True)}
        top = doc[:, :FEATURES]
        is_top = (feats == top[owner]) & (feats > 0)
        d = (up[:, None] * self.p["out"][None, FEATURES:] / chunks[:, None])[owner] + np.where(is_top, (up[:, None] * self.p["out"][None, :FEATURES])[owner], 0)
        d = np.where(feats > 0, d, 0).astype(np.float32)
        g["features"], g["feature_bias"] = pooled.T @ d, d.sum(0)
        d = d @ self.p["features"][:FILTERS].T
        half = np.zeros_like(best)
        from_a = best[a] >= best[b]
        np.add.at(half, a, np.where(from_a, d, 0))
        np.add.at(half, b, np.where(from_a, 0, d))
        half[best <= 0] = 0
        h, f = np.nonzero(half)
        d = half[h, f]
        seen = windows[h * (HALF // STRIDE) + where[h, f]]
        g["filter_bias"] = half.sum(0)
        x = self.p["bytes"][seen].reshape(len(h), -1)
        g["filters"] = np.stack([np.bincount(f, x[:, k] * d, FILTERS) for k in range(x.shape[1])]).astype(np.float32)
        back = (self.p["filters"].T[f] * d[:, None]).reshape(-1, VECTOR)
        g["bytes"] = np.stack([np.bincount(seen.ravel(), back[:, k], 257) for k in range(VECTOR)], 1).astype(np.float32)
        g["bytes"][PAD] = 0
        return g

    def learn(self, texts: list[bytes], label: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam over a fixed number of batches, in an order that the seed fixes; classes weigh the same."""
        rng, waiting = np.random.default_rng(seed), np.empty(0, np.int64)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        weight = (0.5 / np.array([np.mean(label == 0), np.mean(label == 1)]))[label]
        for step in range(1, steps + 1):
            while len(waiting) < BATCH:
                waiting = np.append(waiting, rng.permutation(len(texts)))
            own, waiting = waiting[:BATCH], waiting[BATCH:]
            cut = np.where((label[own] == 1) & (rng.random(BATCH) < CUT_SHARE), rng.integers(10, CUT_BYTES, BATCH), LONGEST)
            g = self.gradients(*_laid_out([texts[i][:n] for i, n in zip(own, cut.tolist())]), label[own], weight[own])
            rate = RATE * (1 - step / (steps + 1))
            for name, x in g.items():
                m[name] += 0.1 * (x - m[name])
                v[name] += 0.001 * (x * x - v[name])
                self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> dict | float:
    """The network's parameters, learnt from at most `sample` rows of docs that have a label of 0 or 1.

    Which rows: half of each class, those with the least hash of the id, then the least id, then text; only texts of at most `longest` bytes. Rows
    with a null id, text or label teach nothing, repeated ones count each. If a class has no row there is nothing to tell apart, and the
    result is the share of 1 (0.5 without any row).
    """
    row = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= longest)
    mark = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    both = row.select("id").join(mark, "id")
    order = [F.xxhash64("id"), F.col("id")]
    few = [both.where(f"label = {k}").orderBy(*order).limit(sample // 2) for k in (0, 1)]
    ids = [r for part in few for r in part.collect()]
    if len({r.label for r in ids}) < 2:
        return float(np.mean([r.label for r in ids])) if ids else 0.5
    chosen = docs.sparkSession.createDataFrame([(r.id, r.label) for r in ids], mark.schema).distinct()
    found = row.join(F.broadcast(chosen), "id").orderBy(*order, "label", "text").limit(2 * sample).collect()  # at most `sample` rows, unless ids are repeated
    return Network().learn([r.text.encode("utf-8", "surrogatepass") for r in found], np.array([r.label for r in found])).p


def _scored(batches: Iterator[pa.RecordBatch], at: int, model) -> Iterator[pa.RecordBatch]:
    network, schema = Network(), None
    network.p = model.value
    for batch in batches:
        texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
        out, k = [], 0
        while k < len(texts):
            size, j = 0, k
            while j < len(texts) and (j == k or size + len(texts[j]) <= AT_ONCE):
                size += len(texts[j])
                j += 1
            if isinstance(network.p, float):
                out.append(np.full(j - k, network.p))
            else:
                out.append(1 / (1 + np.exp(-network.logits(*_laid_out(texts[k:j])).astype(np.float64))))
            k = j
        score = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        schema = schema or pa.schema([f for i, f in enumerate(batch.schema) if i != at] + [("score", pa.float64())])
        yield pa.RecordBatch.from_arrays([*columns, score], schema=schema)


def score(docs: DataFrame, model: dict | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns of `keep`, score): each row's probability of label 1, from its text alone.

    Null and empty texts are a chunk without bytes and get one defined score. Repeated rows are scored each and alike, a null id stays
    null; only the id, the text and `keep` are read, so other columns cannot clash. An empty table gives an empty result. Texts are
    scored whole; a very long one is laid out in two bytes a byte, its filters tried some thousand places at a time. There is no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = unused(docs.select(F.col(id_col).alias("doc_id"), *keep), "text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    last = len(rows.columns) - 1
    return rows.mapInArrow(lambda it: _scored(it, last, sent), f"{kinds}, score double")
