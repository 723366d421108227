"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are binned by quantiles; trees grow by level on
gradient histograms, and are kept as flat arrays that numpy walks for a batch
of documents at once. The model is fitted on at most SAMPLE_ROWS labelled
documents (the smallest hashes of ids); all documents are scored.

Cases: null text counts as empty text, which is scored too; very long texts are
scored whole; null ids and repeated rows are kept; null labels aren't learned
from; of several labels of one id the least counts, and of several texts the
least; a statistic equal to a cut goes left, and of equal gains the first
statistic and cut are taken; without labelled rows each score is 0.5, and where
either label is missing all documents are accepted, since nothing tells them
apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 10_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_ROWS = 12
THRESHOLD = 0.7
STATISTICS = (
    "chars", "words", "mean_word", "longest_word", "lines", "mean_line", "repeated_lines", "distinct_words", "top_word",
    "immediate_repeats", "upper", "digits", "blanks", "symbols", "stops", "bangs", "bars", "non_ascii", "short_words",
    "upper_a_word", "doubled_symbols", "compressed", "entropy", "distinct_share",
)
# Classes of ASCII characters.
DIGIT, UPPER, SPACE, PLAIN_MARK = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\v\f\r", ".,;:!?'\"()-_"
_LOW = "abcdefghijklmnopqrstuvwxyz"
_IS = np.zeros((5, 256), bool)
for _k, _c in enumerate((DIGIT, UPPER, SPACE)):
    _IS[_k, [ord(c) for c in _c]] = True
_IS[3, :128] = ~np.isin(np.arange(128), [ord(c) for c in DIGIT + UPPER + SPACE + PLAIN_MARK + _LOW])
_IS[4, 128:] = True


def statistics(text: str | None) -> list[float]:
    """The document statistics, all finite, in the order of STATISTICS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n, ws, lines = len(text), text.split(), text.split("\n")
    w, counts = len(ws), Counter(ws)
    code = np.frombuffer(raw, np.uint8)
    hist = np.bincount(code, minlength=256)
    digits, upper, blank, symbols, high = (_IS @ hist).tolist()
    per, per_word = 1 / max(1, n), 1 / max(1, w)
    sizes = np.fromiter(map(len, ws), np.int64, w) if w else np.zeros(1, np.int64)
    p = hist[hist > 0] / max(1, len(raw))
    odd = _IS[3][code]
    doubled = int((odd[1:] & odd[:-1]).sum())
    return [
        np.log1p(n), np.log1p(w), float(sizes.mean()), float(np.log1p(sizes.max())), np.log1p(len(lines)), np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines), len(counts) / np.sqrt(max(1, w)), max(counts.values(), default=0) * per_word,
        sum(map(eq, ws, ws[1:])) * per_word, upper * per, digits * per, blank * per, symbols * per,
        (hist[46] + hist[63]) * per_word, hist[33] * per_word, hist[124] * per_word, high * per,
        float((sizes <= 3).mean()), upper * per_word, doubled * per_word,
        len(zlib.compress(raw, 1)) / max(1, len(raw)), float(-(p * np.log2(p)).sum()), len(counts) * per_word,
    ]


class Trees:
    """Flat arrays: node i of a tree has children 2i+1 and 2i+2; a row goes left where its statistic is at most the cut."""

    def __init__(self, base: float):
        self.base, self.column, self.cut, self.value = base, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1))

    @property
    def learned(self) -> bool:
        """Whether documents of both labels were there."""
        return len(self.column) > 0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for column, cut, value in zip(self.column, self.cut, self.value, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[every, column[at]] > cut[at])
            out += value[at - len(column)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Logistic loss, second order; x: rows by statistics, y: 0 or 1. No split is a cut at infinity."""
    if not len(y):
        return Trees(0.0)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)  # c <= e[b] iff bin <= b
    inner, d = 2**DEPTH - 1, x.shape[1]
    score = np.full(len(y), model.base)
    columns, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        column, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(DEPTH):
            low = 2**level - 1
            nodes = 2**level
            flat = ((at - low)[:, None] * d + np.arange(d)) * BINS + binned
            sums = [np.bincount(flat.ravel(), np.repeat(v, d), nodes * d * BINS).reshape(nodes, d, BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (s[:, :, :-1] for s in sums)
            gt, ht, nt = (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            for c, e in enumerate(edges):
                gain[:, c, len(e) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i in np.flatnonzero(gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9):
                c, b = divmod(int(best[i]), BINS - 1)
                column[low + i], cut[low + i] = c, edges[c][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), column[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[leaf]
        columns, cuts, values = [*columns, column], [*cuts, cut], [*values, value]
    model.column, model.cut, model.value = np.array(columns), np.array(cuts), np.array(values)
    return model


def fit(docs: DataFrame, labels: DataFrame, where, sample: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most sample of the labelled documents that where allows; their texts alone are read."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(where).groupBy("doc_id").agg(F.min("quality").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [statistics(t) for t in pdf["text"]]})

    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # SAMPLE_ROWS at most
    told = one.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(rows, "doc_id string, label int, x array<double>")
    found = told.toPandas().sort_values("doc_id")
    return grow(np.array(found["x"].tolist(), float).reshape(-1, len(STATISTICS)), found["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = shared.value.score(np.array([statistics(t) for t in pdf["text"]]).reshape(-1, len(STATISTICS)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype(int)})

    return common.typed(common.texts(docs).mapInPandas(rows, "doc_id string, score double, predicted int"), docs)


def accepted(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches threshold; all rows where the model has seen one label alone or none."""
    if not model.learned:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(STATISTICS)))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(rows, docs.schema)
