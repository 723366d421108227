"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is a path through the lattice of pieces. For a unigram model an
arc weighs its piece's score; for a merge (BPE) model, whose segmentation is the
one in which each two neighbours are what merging them gives, an arc weighs 0
after a neighbour that it agrees with and minus infinity after any other, so
that the best path is the library's own result. Both are max-plus sums.

Texts of up to CHUNK characters are one chunk. Longer ones are cut anywhere. The
states at a cut are the pieces that start before it and reach it; a chunk gives
a transfer matrix of best sums from the states at its left cut to those at its
right cut. Matrices are combined associatively, FAN neighbours at a time, up to
one a document, which fixes its last state; the states at the cuts inside follow
level by level downwards, and each chunk is then traced back by itself. No group
holds more than FAN matrices, however long the document is. No piece reaches
over the start of a word or an unknown character, so a whole word within a chunk
is one arc, and the distinct words of a batch are segmented together.

Cases: null text is empty text, which has no piece; unknown characters fall back
to bytes; a U+2581 in a text decodes as a blank, as in the library; of a unigram
model's paths of equal sums, a text in chunks may get another than in one chunk
(a merge model has one path); null ids and repeated rows are kept; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordbpe import NONE, Pairs, merge_all, spread

CHUNK = 32_768
FAN = 64  # matrices that are combined at once
LONGEST = 32  # characters of a word that is segmented in a batch with others
SPACE = "▁"
OTHER = 1 << 20  # symbol numbers of unknown characters start here
BATCH = 1_000_000
AT_ONCE = 32  # chunks of a batch
CHUNKS_A_TASK = 32  # that are traced back, so that tasks are alike at every size
UNIGRAM, UNKNOWN = 1, 10.0  # fixed values of the library: a model type, and by how much an unknown character is below the least score
State = tuple[int, int]  # start and end of a piece, counted from the cut


class Pieces:
    """A SentencePiece model, BPE or unigram, with byte fallback, read from its file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        path = path or public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.unigram = spec.trainer_spec.model_type == UNIGRAM
        n = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.text[i]: i for i in usable}
        self.score = {self.text[i]: sp.get_score(i) for i in usable}
        self.lost = min(self.score.values()) - UNKNOWN
        self.most = max(map(len, self.ids))
        self.dummy = sp.encode("a", out_type=str)[0].startswith(SPACE)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        singles = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in singles.items():
            self.single[ord(p)] = i
        unknown = self.single < 0
        self.unknown = unknown
        self.single[unknown] = OTHER + np.flatnonzero(unknown)
        order = sorted((p for p in self.ids if len(p) > 1 and SPACE * 2 not in p), key=lambda p: -self.score[p])
        rank = {p: r for r, p in enumerate(order)}
        rows = [(self.ids[p[:k]], self.ids[p[k:]], rank[p]) for p in order for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.pairs = _Ranked(rows, np.array([self.ids[p] for p in order], np.int32))
        self.odd = np.random.default_rng(2).integers(0, 1 << 62, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
        self.agree: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        return (SPACE * self.dummy + text.replace(" ", SPACE)) if text else ""

    def merged(self, word: str) -> list[str]:
        """Plain merging: highest score first, then leftmost."""
        s = list(word)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def fits(self, a: str | None, b: str) -> bool:
        """Whether b may follow a, which is what merging the two leaves; in a unigram model it always may."""
        if self.unigram:
            return True
        if a is None:
            return len(b) == 1 or self.fits("", b)
        if (a, b) not in self.agree:
            if len(self.agree) > 2_000_000:
                self.agree.clear()
            self.agree[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return self.agree[a, b]

    def weight(self, piece: str) -> float:
        """What an arc adds to a path's sum."""
        return self.score.get(piece, self.lost) if self.unigram else 0.0

    def arcs(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start at a place; a character is always one."""
        return [at + 1, *(e for e in range(at + 2, min(len(text), at + self.most) + 1) if text[at:e] in self.ids)]

    def walk(self, text: str, starts: list[State | None], low: int, high: int) -> tuple[dict[State, np.ndarray], dict[State, list[State | None]]]:
        """Best sums from each start to the pieces that start before high, and the pieces before on the way.

        text has context on both sides; a start is the piece before low, or None at the very start of the document.
        """
        ending: dict[int, list[State | None]] = {}
        best: dict[State | None, np.ndarray] = {}
        for i, s in enumerate(starts):
            ending.setdefault(low if s is None else s[1], []).append(s)
            best[s] = np.where(np.arange(len(starts)) == i, 0.0, -np.inf)
        before: dict[State, list[State | None]] = {}
        for at in range(low, high):
            for e in self.arcs(text, at) if at in ending else ():
                piece = text[at:e]
                sums, via = np.full(len(starts), -np.inf), [None] * len(starts)
                for s in ending[at]:
                    if self.fits(None if s is None else text[s[0] : s[1]], piece):
                        better = best[s] > sums
                        sums = np.where(better, best[s], sums)
                        via = [s if y else x for x, y in zip(via, better, strict=True)]
                if np.isfinite(sums).any():
                    best[at, e], before[at, e] = sums + self.weight(piece), via
                    ending.setdefault(e, []).append((at, e))
        return {s: v for s, v in best.items() if s is not None}, before

    def states(self, text: str, cut: int) -> list[State]:
        """All pieces that start before a cut and reach it."""
        return [(a, e) for a in range(max(0, cut - self.most), cut) for e in self.arcs(text, a) if e >= cut]

    def transfer(self, text: str, low: int, high: int, first: bool, last: bool) -> tuple[list[State | None], list[State], np.ndarray]:
        """(states at the left cut, states at the right cut, matrix of best sums), states counted from their cut.

        From the first word start on, all starts share one way, and the words up to the last one's start are one arc each.
        """
        left: list[State | None] = [None] if first else list(self.states(text, low))
        right = self.states(text, high)
        if last:
            right = [s for s in right if s[1] == high]
        marks = self.word_starts(text, low + self.most, high)
        if len(marks) > 1:
            sums, _ = self.walk(text, left, low, marks[0])
            head = np.max([v for s, v in sums.items() if s[1] == marks[0]] or [np.full(len(left), -np.inf)], axis=0)
            tail, _ = self.walk(text, [None], marks[-1], high)
            if self.unigram:
                head = head + sum(map(self.weight, map(self.text.__getitem__, self.encode_words([text[marks[0] : marks[-1]]])[0].tolist())))
            matrix = head[:, None] + np.array([tail.get(s, np.array([-np.inf]))[0] for s in right])
        else:
            sums, _ = self.walk(text, left, low, high)
            matrix = np.stack([sums.get(s, np.full(len(left), -np.inf)) for s in right], 1)
        return [None if s is None else (s[0] - low, s[1] - low) for s in left], [(a - high, e - high) for a, e in right], matrix

    def word_starts(self, text: str, low: int, high: int) -> list[int]:
        return [i for i in range(max(1, low), high) if text[i] == SPACE != text[i - 1]]

    def trace(self, text: str, left: State | None, right: State, low: int, high: int) -> list[int]:
        """Ids of the pieces after the left state up to the right one, which may reach over the cut."""
        left = None if left is None else (left[0] + low, left[1] + low)
        begin, end = low if left is None else left[1], right[1] + high
        marks = self.word_starts(text, max(begin, low + self.most), high)
        if len(marks) > 1:
            head = self.back(text, left, low, marks[0], None)
            middle = self.encode_words([text[marks[0] : marks[-1]]])[0]
            tail = self.back(text, None, marks[-1], high, (right[0] + high, end))
            return [*head, *middle.tolist(), *tail]
        return self.back(text, left, low, high, (right[0] + high, end))

    def back(self, text: str, start: State | None, low: int, high: int, goal: State | None) -> list[int]:
        sums, before = self.walk(text, [start], low, high)
        if goal is None:
            goal = max((s for s in sums if s[1] == high and s in before), key=lambda s: sums[s][0], default=None)
        out: list[State] = []
        at = goal
        while at is not None and at != start:
            out.append(at)
            at = before[at][0]
        return [i for a, e in reversed(out) for i in self.ids_of(text[a:e])]

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def encode_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normal texts that start and end at the start of a word: distinct words are segmented once, many together."""
        point = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        text_at = np.append(0, np.cumsum(sizes))
        if not len(point):
            return [np.zeros(0, np.int32)] * len(texts)
        space, unknown = point == ord(SPACE), self.unknown[point]
        first = np.zeros(len(point), bool)
        first[1:] = (space[1:] & ~space[:-1]) | unknown[1:] | unknown[:-1]
        first[text_at[:-1][sizes > 0]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(point)))
        double = np.zeros(len(point), np.int64)
        double[1:] = space[1:] & space[:-1]
        apart = np.flatnonzero((size > LONGEST) | (np.add.reduceat(double, start) > 0))
        if self.unigram:
            apart = np.arange(len(start))
        short = np.minimum(size, LONGEST)
        place = spread(np.zeros(len(start), np.int64), short)
        value = (point[spread(start, short)].astype(np.uint64) + np.uint64(1)) * self.odd[place]
        key = np.add.reduceat(value, np.cumsum(short) - short)
        key[apart] = np.arange(len(apart))
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        flat, counts = self._segment(point, start[one], size[one], np.isin(one, apart))
        n = counts[number]
        ids = flat[spread((np.cumsum(counts) - counts)[number], n)]
        ends = np.append(0, np.cumsum(n))[np.searchsorted(start, text_at)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _segment(self, point: np.ndarray, start: np.ndarray, size: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, order, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], np.zeros(len(start), np.int64)
        low = 1
        for high in (5, 9, 14, LONGEST):
            which = np.flatnonzero((size >= low) & (size <= high) & ~apart)
            low = high + 1
            for at in range(0, len(which), 20_000):
                part = which[at : at + 20_000]
                grid = self.single[point[np.minimum(start[part][:, None] + np.arange(high), len(point) - 1)]]
                grid = np.where(np.arange(high) < size[part][:, None], grid, -1).astype(np.int32)
                flat, n = merge_all(grid, size[part], self.pairs)
                if (flat >= OTHER).any():
                    flat, n = self._to_bytes(flat, n)
                parts.append(flat)
                order.append(part)
                counts[part] = n
        for i in np.flatnonzero(apart):
            word = point[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le")
            found = self.back(word, None, 0, len(word), None) if self.unigram or len(word) > 2 * LONGEST else [x for p in self.merged(word) for x in self.ids_of(p)]
            parts.append(np.array(found, np.int32))
            order.append(np.array([i]))
            counts[i] = len(found)
        flat, order = np.concatenate(parts), np.concatenate(order)
        begin = np.empty(len(start), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(begin, counts)], counts

    def _to_bytes(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(n)), n)
        lists = [[x] if x < OTHER else [self.bytes[b] for b in chr(x - OTHER).encode()] for x in flat.tolist()]
        each = np.array([len(x) for x in lists])
        return np.array([y for x in lists for y in x], np.int32), np.bincount(row, each, len(n)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts, of any length."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(self.normal(t or ""))
            size += len(held[-1])
            if size >= BATCH:
                out += self.encode_words(held)
                held, size = [], 0
        return out + (self.encode_words(held) if held else [])

    @property
    def raw(self) -> list[bytes]:
        if not hasattr(self, "_raw"):
            byte = {i: bytes([b]) for b, i in self.bytes.items()}
            self._raw = [byte.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.text)]
        return self._raw

    def decode(self, ids, first: bool = True) -> bytes:
        """UTF-8 of ids; first: they begin the text, whose leading blank goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:] if first and self.dummy and raw[:1] == b" " else raw


class _Ranked(Pairs):
    """Pairs of one result share its rank, so that the leftmost of them is merged first."""

    def __init__(self, rows: list[tuple[int, int, int]], new: np.ndarray):
        super().__init__(rows)
        self.order = np.array([r for _, _, r in rows] + [0], np.int32)
        self.new = new

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = super().rank(a, b)
        hit = found < NONE
        found[hit] = self.order[found[hit]]
        return found


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path)


def digest(ids) -> tuple[int, int, int]:
    """Number, sum, and sum weighted by place: digests that can be merged along a document."""
    x = np.asarray(ids, np.int64)
    return len(x), int(x.sum()), int((x * np.arange(len(x))).sum())


def chunk_rows(docs: DataFrame, path: str | None, chunk: int) -> DataFrame:
    """Chunks of the texts longer than chunk: row, k, last, low, high, and the chunk with its context on both sides."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(path)
        for pdf in batches:
            for row, doc, text in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True):
                t = m.normal(text)
                n = max(1, len(t) // chunk)
                cuts = [len(t) * k // n for k in range(n + 1)]
                for first in range(0, n, AT_ONCE):
                    ks = range(first, min(n, first + AT_ONCE))
                    ends = [(max(0, cuts[k] - m.most), min(len(t), cuts[k + 1] + m.most)) for k in ks]
                    yield pd.DataFrame({"row": row, "doc_id": doc, "k": ks, "last": [k == n - 1 for k in ks], "low": [cuts[k] - a for k, (a, _) in zip(ks, ends)],
                                        "high": [cuts[k + 1] - a for k, (a, _) in zip(ks, ends)], "part": [t[a:b] for a, b in ends]})

    long = docs.where(F.char_length("text") > chunk)
    long = common.texts(long).withColumn("row", F.monotonically_increasing_id())
    return long.mapInPandas(rows, "row long, doc_id string, k int, last boolean, low int, high int, part string")


def plus(a: tuple, b: tuple) -> tuple:
    """The max-plus product of two transfers: associative."""
    place = {s: i for i, s in enumerate(b[0])}
    at = [place[s] for s in a[1]]
    return a[0], b[1], np.max(a[2][:, :, None] + b[2][at][None], axis=1)


def settle(parts: list[tuple], start: State | None, goal: State) -> list[tuple[State | None, State]]:
    """The state at each part's left and right cut on the best path from start, a state at the first cut, to goal, one at the last."""
    reach = [np.where([x == start for x in parts[0][0]], 0.0, -np.inf)]
    for k, (left, right, matrix) in enumerate(parts):
        if k:
            place = {x: i for i, x in enumerate(parts[k - 1][1])}
            reach[k] = reach[k][[place[x] for x in left]]
        reach.append(np.max(reach[k][:, None] + matrix, axis=0))
    out: list[tuple[State | None, State]] = []
    state = goal
    for k in range(len(parts) - 1, -1, -1):
        left, right, matrix = parts[k]
        at = left[int(np.argmax(reach[k] + matrix[:, right.index(state)]))]
        out.append((at, state))
        state = at
    return out[::-1]


def best_end(part: tuple) -> State:
    """The last state of a whole document's best path."""
    return part[1][int(np.argmax(part[2][0]))]


def _read(pdf: pd.DataFrame) -> list[tuple]:
    """Transfers from rows in order; a document's first one starts at None."""
    out = []
    for r in pdf.itertuples():
        left, right = ([(int(a), int(b)) for a, b in np.reshape(x, (-1, 2))] for x in (r.left, r.right))
        out.append(([None] if r.k == 0 else left, right, np.reshape(r.matrix, (len(left), len(right)))))
    return out


def _row(row: int, k: int, part: tuple) -> tuple:
    return row, k, [x for s in part[0] for x in (s or (0, 0))], [x for s in part[1] for x in s], part[2].ravel()


MATRICES = "row long, k int, left array<int>, right array<int>, matrix array<double>"
STATES = "row long, k int, a array<int>, b array<int>"


def states_at_cuts(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """row, k, a, b: the states at the left and right cut of each chunk, from the chunks' matrices, by a tree of products of fan of them."""
    levels = [matrices]
    n = matrices.agg(F.max("k")).first()[0]
    group = F.expr(f"k div {fan}").cast("int")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame([_row(pdf["row"].iloc[0], pdf["g"].iloc[0], reduce(plus, _read(pdf)))], columns=["row", "k", "left", "right", "matrix"])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row": pdf["row"], "k": 0, "a": [[0, 0]] * len(pdf), "b": [list(best_end(p)) for p in _read(pdf)]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        first = pdf.iloc[0]
        told = settle(_read(pdf), None if first["k"] == 0 else tuple(map(int, first["a"])), tuple(map(int, first["b"])))
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "k": pdf["k"].to_numpy(), "a": [list(x or (0, 0)) for x, _ in told], "b": [list(y) for _, y in told]})

    while n:  # the greatest number of a chunk; 0 where each document is one
        up = levels[-1].withColumn("g", group).groupBy("row", "g").applyInPandas(product, MATRICES)
        levels.append(common.durable(up, "products"))
        n //= fan
    states = levels[-1].mapInPandas(last, STATES)
    for level in reversed(levels[:-1]):
        outer = states.select("row", F.col("k").alias("g"), "a", "b")
        states = level.withColumn("g", group).join(outer, ["row", "g"]).groupBy("row", "g").applyInPandas(inside, STATES)
    return states


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, part, ids, round_trip: the ids of each text, in parts where it is long (part counts from 0)."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(path)
        for pdf in batches:
            ids = m.encode(pdf["text"].tolist())
            same = [m.decode(x.tolist()) == (t or "").replace(SPACE, " ").encode() for x, t in zip(ids, pdf["text"], strict=True)]
            yield pd.DataFrame({"row": None, "doc_id": pdf["doc_id"], "part": 0, "ids": ids, "round_trip": same})

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(path)
        for pdf in batches:
            out = [_row(r.row, r.k, m.transfer(r.part, r.low, r.high, r.k == 0, r.last)) for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["row", "k", "left", "right", "matrix"])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pieces(path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                left, right = (None if r.k == 0 else tuple(r.a)), tuple(r.b)
                ids = m.trace(r.part, left, right, r.low, r.high)
                text = r.part[r.low + (left[1] if left else 0) : r.high + right[1]].replace(SPACE, " ").encode()
                out.append((r.row, r.doc_id, r.k, ids, m.decode(ids, False) == text))
            yield pd.DataFrame(out, columns=["row", "doc_id", "part", "ids", "round_trip"])

    schema = "row long, doc_id string, part int, ids array<int>, round_trip boolean"
    short = common.texts(docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk)).mapInPandas(whole, schema)
    cut = common.durable(chunk_rows(docs, path, chunk), "chunks")
    tasks = -(-cut.count() // CHUNKS_A_TASK) or 1
    matrices = common.durable(cut.mapInPandas(transfers, MATRICES), "matrices")
    long = cut.repartition(tasks, "row", "k").join(states_at_cuts(matrices, fan), ["row", "k"]).mapInPandas(traced, schema)
    return common.typed(short.unionByName(long), docs)


def report(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_ids, ids_sum, ids_weighted (sum of id by place), parts, round_trip of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [digest(x.as_py()) if not isinstance(x, np.ndarray) else digest(x) for x in _arrays(b.column("ids"))]
            n, s, w = (pa.array([t[i] for t in told], pa.int64()) for i in range(3))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "row": b.column("row"), "part": b.column("part"), "n": n, "s": s, "w": w, "ok": b.column("round_trip")})

    found = encode(docs, path, chunk, fan).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = common.durable(found.mapInArrow(rows, "doc_id string, row long, part int, n long, s long, w long, ok boolean"), "digests")  # both kinds of rows are read from it
    one = found.where("row IS NULL").selectExpr("doc_id", "n AS n_ids", "s AS ids_sum", "w AS ids_weighted", "1L AS parts", "ok AS round_trip")
    many = found.where("row IS NOT NULL").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "s", "w"))).alias("p"), F.bool_and("ok").alias("round_trip"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("w"))
    total = F.aggregate("p", start, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s"), (a["w"] + x["w"] + a["n"] * x["s"]).alias("w")))
    many = many.select("doc_id", total.alias("t"), F.size("p").cast("long").alias("parts"), "round_trip")
    many = many.selectExpr("doc_id", "t.n AS n_ids", "t.s AS ids_sum", "t.w AS ids_weighted", "parts", "round_trip")
    return common.typed(one.unionByName(many), docs)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    offset, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]
