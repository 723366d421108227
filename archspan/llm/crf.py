"""Language identification by a linear-chain conditional random field.

Words are labelled by forward-backward over affix, n-gram and lexicon features
with learned transitions, so that a text may switch language between words; a
document's language is the one with the largest mean marginal. The model is
fitted by gradient ascent on a bounded sample of labelled documents (of each
language PER_LANGUAGE, the smallest hashes of ids); each word of a sampled
document carries the document's label. Besides, passages of sampled documents of
different languages are joined, so that transitions learn how often a text
switches and not only that it stays.

Long texts are cut in blocks of words: a block's transfer matrix carries the
state across it, the matrices of a document are chained from both ends, and the
marginals inside each block then follow from its own ends. This is exact.

Cases: null text, or text without a letter: language 'und', score 0; null ids
and repeated rows are kept, and of the texts of a repeated id the least is
learned from; of equal means the first language by name wins; without labelled
rows each language is 'und'; very long texts are labelled whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordbpe import LETTER, classes, spread

PER_LANGUAGE = 250
PARTS = 16  # of a language, in which the sample is drawn first
JOINED = 0.5  # joined passages, a sampled document
PASSAGE = (5, 40)  # words of a passage
HASHED = 1 << 17
BLOCK = 128
ROUNDS = 20
AT_ONCE = 2_000_000  # characters that are labelled at once
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words (runs of letters, in lower case) of some texts; the distinct ones by a 64-bit key."""

    point: np.ndarray  # code points of all texts
    start: np.ndarray  # of the distinct words
    size: np.ndarray
    key: np.ndarray
    number: np.ndarray  # of each word in turn: its place among the distinct ones
    first: np.ndarray  # of each word in turn: where it begins in point
    per_text: np.ndarray  # words of each text
    text_at: np.ndarray  # where each text begins in point


def find_words(texts: list[str | None]) -> Words:
    low = [t.lower() if t else "" for t in texts]
    point = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (classes()[point] == LETTER).astype(np.int8)
    turn = np.diff(letter)
    start, end = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
    size = end - start
    text_at = 1 + np.append(0, np.cumsum([len(t) + 1 for t in low]))
    per_text = np.diff(np.searchsorted(start, text_at))
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(point, none, none, none.astype(np.uint64), none, none, per_text, text_at[:-1])
    power = np.multiply.accumulate(np.full(int(size.max()), PRIME))
    at = spread(start, size)
    value = (point[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(start, size)]
    key = np.add.reduceat(value, np.cumsum(size) - size)
    distinct, one, number = np.unique(key, return_index=True, return_inverse=True)
    return Words(point, start[one], size[one], distinct, number, start, per_text, text_at[:-1])


def _hashed(tag: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), tag * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return ((h * PRIME) >> np.uint64(64 - 17)).astype(np.int64)


def features(w: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, hashed feature): character n-grams, affixes, the word, and what the lexicon says of it."""
    n = len(w.start)
    owner, at = np.repeat(np.arange(n), w.size), spread(w.start, w.size)
    end = w.start + w.size
    here, before, after = (w.point[at + k].astype(np.uint64) for k in (0, -1, 1))
    inside, last = at > np.repeat(w.start, w.size), at + 1 == np.repeat(end, w.size)
    before, after = before * inside, after * ~last
    every = np.arange(n)
    out = [
        (owner, _hashed(1, before, here)), (every, _hashed(1, w.point[end - 1], np.zeros(n))),
        (owner, _hashed(2, before, here, after)), (every, _hashed(3, w.key)),
    ]
    prefix, suffix = [], []
    for k in range(1, 5):
        long = np.flatnonzero(w.size >= k)
        prefix, suffix = [w.point[w.start[long] + i] for i in range(k)], [w.point[end[long] - 1 - i] for i in range(k)]
        out += [(long, _hashed(10 + k, *prefix)), (long, _hashed(20 + k, *suffix))]
    keys, label = lexicon
    if len(keys):
        i = np.minimum(np.searchsorted(keys, w.key), len(keys) - 1)
        out.append((every, _hashed(4, np.where(keys[i] == w.key, label[i] + 1, 0))))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def transfer(psi: np.ndarray, length: np.ndarray, trans: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Matrices that carry a state across blocks, each scaled to a largest entry of 1. psi: block, place, label. A block that opens a text is entered without a step."""
    n, t, k = psi.shape
    m = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for i in range(t):
        step = m @ trans
        if not i:
            step = np.where(opens[:, None, None], m, step)
        m = np.where((i < length)[:, None, None], step * psi[:, i, None, :], m)
        m /= m.max(axis=(1, 2), keepdims=True)
    return m


def marginals(psi: np.ndarray, length: np.ndarray, trans: np.ndarray, entry: np.ndarray, last: np.ndarray):
    """Marginals of places in blocks, given the weights with which the first place is entered and of the state at the end. Places beyond length: no step."""
    n, t, k = psi.shape
    alpha, beta = np.empty((t, n, k)), np.empty((t, n, k))
    a = entry
    for i in range(t):
        on = (i < length)[:, None]
        a = np.where(on, (a @ trans if i else a) * psi[:, i], a)
        a = a / a.sum(1, keepdims=True)
        alpha[i] = a
    b = last
    for i in range(t - 1, -1, -1):
        beta[i] = b
        on = (i < length)[:, None]
        b = np.where(on, (b * psi[:, i]) @ trans.T, b)
        b = b / b.sum(1, keepdims=True)
    out = alpha * beta
    return out / out.sum(2, keepdims=True), alpha, beta


def grid(number: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of words: word numbers (block by place), lengths, and the text of each block."""
    blocks = -(-per_text // BLOCK)
    text = np.repeat(np.arange(len(per_text)), blocks)
    k = spread(np.zeros(len(per_text), np.int64), blocks)
    length = np.minimum(BLOCK, per_text[text] - k * BLOCK)
    out = np.zeros((len(text), int(length.max()) if len(text) else 1), np.int64)
    row = np.repeat(np.arange(len(text)), length)
    out[row, spread(np.zeros(len(text), np.int64), length)] = number
    return out, length, text


class Crf:
    """labels, lexicon (sorted keys and label numbers), emission weights by hashed feature, transition scores; start is uniform."""

    def __init__(self, labels: list[str], lexicon: tuple[np.ndarray, np.ndarray]):
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((HASHED, max(1, len(labels))))
        self.moves = np.zeros((max(1, len(labels)),) * 2)

    def emit(self, owner: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        score = np.stack([np.bincount(owner, self.weights[which, j], n) for j in range(self.weights.shape[1])], 1)
        return np.exp(np.clip(score - score.max(1, keepdims=True), -60, 0)) + 1e-12

    def label_words(self, w: Words) -> np.ndarray:
        """The marginals of all words in turn: words by labels."""
        k = len(self.moves)
        if not len(w.number):
            return np.zeros((0, k))
        trans = np.exp(self.moves - self.moves.max())
        owner, which = features(w, self.lexicon)
        psi_v = self.emit(owner, which, len(w.key))
        ids, length, text = grid(w.number, w.per_text)
        psi = psi_v[ids]
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        sizes = np.diff(np.append(starts, len(text)))
        first, last = np.full((len(text), k), 1 / k), np.full((len(text), k), 1 / k)
        opens = np.zeros(len(text), bool)
        opens[starts] = True
        if sizes.max() > 1:
            many = np.flatnonzero(np.repeat(sizes > 1, sizes))
            chain = np.zeros((len(text), k, k))
            chain[many] = transfer(psi[many], length[many], trans, opens[many])
            for j in range(1, sizes.max()):  # all texts that have a block j at once
                at = starts[sizes > j] + j
                v = (first[at - 1, None, :] @ chain[at - 1])[:, 0]
                first[at] = v / v.sum(1, keepdims=True)
            for j in range(sizes.max() - 1, 0, -1):
                at = starts[sizes > j] + j
                v = (chain[at] @ last[at][:, :, None])[:, :, 0]
                last[at - 1] = v / v.sum(1, keepdims=True)
        found, _, _ = marginals(psi, length, trans, np.where(opens[:, None], first, first @ trans), last)
        return found.transpose(1, 0, 2)[np.arange(ids.shape[1])[None, :] < length[:, None]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            w = find_words(texts[at:end])
            m, owner = self.label_words(w), np.repeat(np.arange(end - at), w.per_text)
            sums = np.stack([np.bincount(owner, m[:, j], end - at) for j in range(m.shape[1])], 1) / np.maximum(1, w.per_text)[:, None]
            best = sums.argmax(1)
            for n, i, p in zip(w.per_text, best, sums[np.arange(end - at), best], strict=True):
                out.append((self.labels[i], float(min(1.0, p))) if n and self.labels else ("und", 0.0))
            at = end
        return out

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of words with one likeliest language, in code points of the lower-case text."""
        w = find_words([text])
        if not len(w.number):
            return []
        best, start = self.label_words(w).argmax(1), w.first - w.text_at[0]
        end = start + w.size[w.number]
        cut = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        return [(int(start[a]), int(end[b]), self.labels[best[a]]) for a, b in zip(cut, np.append(cut[1:], len(best)) - 1, strict=True)]


def joined(texts: list[str], langs: list[str], share: float = JOINED) -> list[list[tuple[str, str]]]:
    """Samples of two to four passages, each of another language than the one before."""
    rng = np.random.default_rng(5)
    by = {k: [t.split() for t, x in zip(texts, langs, strict=True) if x == k] for k in sorted(set(langs))}
    by = {k: [w for w in v if w] for k, v in by.items()}
    names, out = [k for k in by if by[k]], []
    for _ in range(int(share * len(texts)) if len(names) > 1 else 0):
        sample, last = [], None
        for _ in range(rng.integers(2, 5)):
            last = str(rng.choice([k for k in names if k != last]))
            words = by[last][rng.integers(len(by[last]))]
            at = rng.integers(len(words))
            sample.append((" ".join(words[at : at + rng.integers(*PASSAGE)]), last))
        out.append(sample)
    return out


def train(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Crf:
    """Maximum conditional likelihood, L2-regularised, by Adagrad on all blocks of the sample and of passages joined from it."""
    samples = [[(t, x)] for t, x in zip(texts, langs, strict=True)] + joined(texts, langs)
    labels = sorted(set(langs))
    k = len(labels)
    w = find_words([t for s in samples for t, _ in s])
    lang = np.searchsorted(labels, [x for s in samples for _, x in s])
    own = np.arange(len(texts))
    pair = np.unique(np.repeat(own, w.per_text[own]) * max(1, len(w.key)) + w.number[: w.per_text[own].sum()])
    held = np.zeros((len(w.key), k))
    np.add.at(held, (pair % max(1, len(w.key)), lang[pair // max(1, len(w.key))]), 1)
    sure = (held.sum(1) >= 3) & (held.max(1, initial=0) >= 0.8 * held.sum(1))
    model = Crf(labels, (w.key[sure], held[sure].argmax(1)))
    if k < 2 or not len(w.number):
        return model
    owner, which = features(w, model.lexicon)
    sizes = np.array([len(s) for s in samples])
    per_sample = np.add.reduceat(w.per_text, np.cumsum(sizes) - sizes)
    ids, length, text = grid(w.number, per_sample)
    there = np.arange(ids.shape[1])[None, :] < length[:, None]
    total, flat_word, flat_gold = there.sum(), ids[there], np.repeat(lang, w.per_text)
    gold = np.full(ids.shape, -1)
    gold[there] = flat_gold
    counts_gold = np.zeros((k, k))
    both = there[:, 1:]
    np.add.at(counts_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    sums_w, sums_m = np.full(model.weights.shape, 1e-12), np.full((k, k), 1e-12)
    even = np.full((len(text), k), 1 / k)
    for _ in range(rounds):
        trans = np.exp(model.moves - model.moves.max())
        psi = model.emit(owner, which, len(w.key))[ids]
        found, alpha, beta = marginals(psi, length, trans, even, even)
        expect = np.zeros((k, k))
        for i in range(1, ids.shape[1]):
            on = i < length
            both = alpha[i - 1][on][:, :, None] * trans * (psi[on, i] * beta[i][on])[:, None, :]
            expect += (both / both.sum((1, 2), keepdims=True)).sum(0)
        error = -found.transpose(1, 0, 2)[there]
        error[np.arange(len(error)), flat_gold] += 1
        by_word = np.stack([np.bincount(flat_word, error[:, j], len(w.key)) for j in range(k)], 1)
        grad = np.stack([np.bincount(which, by_word[owner, j], HASHED) for j in range(k)], 1) / total - 1e-6 * model.weights
        sums_w += grad**2
        model.weights += 0.2 * grad / np.sqrt(sums_w)
        step = (counts_gold - expect) / total - 1e-4 * model.moves
        sums_m += step**2
        model.moves += 0.2 * step / np.sqrt(sums_m)
    return model


def fit(docs: DataFrame, where, per_language: int = PER_LANGUAGE) -> Crf:
    """A model from at most per_language documents of each language, of those that where allows and that have text and lang."""
    chosen = docs.where(where).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    ids = chosen.select("lang", "doc_id").distinct().withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # first within parts of a language, since one may hold most rows
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    same = [chosen["doc_id"].eqNullSafe(F.col("__id")), chosen["lang"] == F.col("__lang")]
    rows = chosen.join(F.broadcast(ids.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"))), same, "left_semi")
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "lang"])
    if rows.empty:
        return Crf([], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return train(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score for each row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            told = m.predict(pdf["text"].tolist())
            yield pd.concat([pdf[["doc_id"]], pd.DataFrame(told, columns=["lang_pred", "score"], index=pdf.index)], axis=1)

    return common.typed(common.texts(docs).mapInPandas(rows, "doc_id string, lang_pred string, score double"), docs)
