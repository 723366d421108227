"""Ids of many texts at once: pre-tokens and byte-pair merges as numpy arrays.

The corpus has a long tail of words that occur once, for which a tokenizer
object for each word costs more than the merges. The model file is the one of
the tokenizers library, and so are the ids. Texts whose lower case or special
tokens depend on more than a letter, and very long words, go to the library.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

LONGEST = 48  # bytes of a word that is merged here
BATCH = 1_000_000  # characters that are encoded at once
NONE = np.int32(1 << 30)
SPECIAL = "<|"
BLANK, LETTER, NUMBER, SYMBOL = range(4)
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")  # fixed values: what makes a word of its own behind an apostrophe


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own, or else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Pairs:
    """Rank and result of a pair of symbols, by two hash tables: the second one for pairs that meet in the first."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        a, b, new = np.array(pairs, np.uint64).T
        self.key = np.append((a << np.uint64(32)) | b, np.uint64(1 << 63))
        self.new = np.append(new.astype(np.int32), np.int32(-1))
        self.first, late = self._table(np.arange(len(pairs)), 20, 0x9E3779B97F4A7C15)
        for odd in range(1, 1000, 2):
            self.mult = 0xBF58476D1CE4E5B9 + odd * 2
            self.second, lost = self._table(late, 20, self.mult)
            if not len(lost):
                break
        else:
            raise ValueError("no table without collisions")

    def _slot(self, key: np.ndarray, bits: int, mult: int) -> np.ndarray:
        return ((key * np.uint64(mult)) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, which: np.ndarray, bits: int, mult: int) -> tuple[np.ndarray, np.ndarray]:
        table = np.full(1 << bits, len(self.key) - 1, np.int32)
        slot = self._slot(self.key[which], bits, mult)
        table[slot[::-1]] = which[::-1]
        return table, which[table[slot] != which]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge number of each pair, NONE where there is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        found = self.first[self._slot(key, 20, 0x9E3779B97F4A7C15)]
        miss = np.flatnonzero(self.key[found] != key)
        again = self.second[self._slot(key[miss], 20, self.mult)]
        found[miss] = np.where(self.key[again] == key[miss], again, NONE)
        return found


class WordIds:
    """Ids of texts, as little-endian bytes. No token crosses a blank, so words are encoded once and their ids joined."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.last = np.array([vocab[c + model["end_of_word_suffix"]] for c in byte_characters()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = Pairs([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        rng = np.random.default_rng(1)
        self.odd = rng.integers(0, 1 << 63, LONGEST + 1, np.uint64) * np.uint64(2) + np.uint64(1)

    def merged(self, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that lie at start in the bytes, one behind the other; how many each has."""
        parts, counts = [], np.zeros(len(start), np.int64)
        order = []
        low = 1
        for high in (6, 10, 16, LONGEST):
            which = np.flatnonzero((size >= low) & (size <= high))
            low = high + 1
            for at in range(0, len(which), 20_000):
                part = which[at : at + 20_000]
                grid = code[np.minimum(start[part][:, None] + np.arange(high), len(code) - 1)]
                flat, n = self._merge(grid, size[part])
                parts.append(flat)
                counts[part] = n
                order.append(part)
        for i in np.flatnonzero(size > LONGEST):
            found = self.library.encode(code[start[i] : start[i] + size[i]].tobytes().decode(), add_special_tokens=False).ids
            parts.append(np.array(found, np.int32))
            counts[i] = len(found)
            order.append(np.array([i]))
        order = np.concatenate([np.zeros(0, np.int64), *order])
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        begin = np.empty(len(start), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(begin, counts)], counts

    def _merge(self, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = code.shape
        symbols = np.where(np.arange(width) < length[:, None], self.inner[code], -1).astype(np.int32)
        symbols[np.arange(n), length - 1] = self.last[code[np.arange(n), length - 1]]
        return merge_all(symbols, length, self.pairs)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-case texts. A pre-token is a run of letters, a number, or a run of symbols; see ENDINGS."""
        whole = "\n".join(texts) + "\n"
        point = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        code = np.frombuffer(whole.encode(), np.uint8)
        kind = classes()[point]
        first = np.empty(len(point), bool)
        first[0], first[1:] = True, kind[1:] != kind[:-1]
        first |= kind == NUMBER
        apostrophe = np.flatnonzero(first & (point == 39))
        if len(apostrophe):
            ahead = [point[np.minimum(apostrophe + k, len(point) - 1)] for k in (1, 2)]
            for end in ENDINGS:
                hit = ahead[0] == ord(end[0])
                if len(end) == 2:
                    hit &= ahead[1] == ord(end[1])
                at = apostrophe[hit]
                for k in range(1, len(end) + 1):
                    first[at + k] = False
                behind = at + len(end) + 1
                first[behind[kind[behind] == LETTER]] = True
        width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000).astype(np.int64)
        at_byte = np.append(0, np.cumsum(width))
        starts = np.flatnonzero(first)
        size = np.diff(at_byte[np.append(starts, len(point))])
        real = kind[starts] != BLANK
        starts, size = starts[real], size[real]
        begin = at_byte[starts]
        lines = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        if not len(starts):
            return [b""] * len(texts)
        short = np.minimum(size, LONGEST)
        place = spread(np.zeros(len(starts), np.int64), short)
        value = (code[np.repeat(begin, short) + place].astype(np.uint64) + np.uint64(1)) * self.odd[place]
        key = np.add.reduceat(value, np.cumsum(short) - short)
        key[size > LONGEST] = np.arange((size > LONGEST).sum())  # long ones stay apart
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        flat, counts = self.merged(code, begin[one], size[one])
        offset = np.cumsum(counts) - counts
        n = counts[number]
        ids = flat[spread(offset[number], n)].astype("<u4")
        ends = np.append(0, np.cumsum(n))[np.searchsorted(starts, lines)] * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [SPECIAL in t or not t.isascii() and ("Σ" in t or "İ" in t or not is_normalized("NFC", t)) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if odd[i]:  # here lower case or special tokens depend on more than a letter
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            held.append(i)
            size += len(t)
            if size >= BATCH:
                self._fill(out, texts, held)
                held, size = [], 0
        self._fill(out, texts, held)
        return out

    def _fill(self, out: list[bytes], texts: list[str], held: list[int]) -> None:
        if held:
            for i, x in zip(held, self._plain([texts[i].lower() for i in held]), strict=True):
                out[i] = x


def merge_all(symbols: np.ndarray, length: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of rows (padded by -1) after all merges, row behind row, and how many each row has: the leftmost pair of least rank first."""
    n, width = symbols.shape
    done, length = np.full((n, width), -1, np.int32), length.copy()
    row = np.arange(n)
    if width == 1:
        return symbols.ravel(), length
    rank = pairs.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
    while True:
        best = rank.argmin(1)
        least = rank[np.arange(len(rank)), best]
        live = least < NONE
        if not live.all():
            over = ~live
            done[row[over], : symbols.shape[1]] = symbols[over]
            row, symbols, rank, best, least = row[live], symbols[live], rank[live], best[live], least[live]
        if not len(row):
            break
        every, w = np.arange(len(row)), symbols.shape[1]
        symbols[every, best] = pairs.new[least]
        symbols = np.take_along_axis(symbols, np.arange(w - 1) + (np.arange(w - 1) > best[:, None]), 1)
        length[row] -= 1
        if w == 2:
            done[row, :1] = symbols
            break
        rank = np.take_along_axis(rank, np.arange(w - 2) + (np.arange(w - 2) >= best[:, None]), 1)
        for shift in (-1, 0):  # only the pairs beside the new symbol change
            at = best + shift
            ok = (at >= 0) & (at < w - 2)
            rank[every[ok], at[ok]] = pairs.rank(symbols[every[ok], at[ok]], symbols[every[ok], at[ok] + 1])
    return done[done >= 0], length


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each entry, counts numbers each, one entry behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


@lru_cache(maxsize=2)
def word_ids(path: str | None = None) -> WordIds:
    return WordIds(path)
