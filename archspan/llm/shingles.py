"""Sets of word shingles of texts, as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from .wordbpe import spread

PRIME = np.uint64(0x9E3779B97F4A7C15)
AT_ONCE = 1_500_000  # bytes of text that are hashed at once
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z, and no other letters
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    code = _FOLD[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    turn = np.diff((~_BLANK[code]).astype(np.int8))
    start, size = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) - np.flatnonzero(turn == 1)
    counts = np.zeros(len(texts), np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    power = np.multiply.accumulate(np.full(int(size.max()), PRIME))
    at = spread(start, size)
    value = (code[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(start, size)]
    word = mixed(np.add.reduceat(value, np.cumsum(size) - size))
    text_at = 1 + np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    n = np.diff(np.searchsorted(start, text_at))
    first = np.cumsum(n) - n
    full = np.maximum(0, n - words + 1)
    doc, i = np.repeat(np.arange(len(texts)), full), spread(first, full)
    h = np.zeros(len(i), np.uint64)
    for k in range(words):
        h = (h + word[i + k]) * PRIME
    short = np.flatnonzero((n > 0) & (n < words))
    extra = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        on = n[short] > k
        extra[on] = (extra[on] + word[first[short[on]] + k]) * np.uint64(0xD6E8FEB86659FD93)
    doc, h = np.append(doc, short), mixed(np.append(h, extra))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    return h[new], np.bincount(doc[new], minlength=len(texts))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text behind the other; and how many each text has.

    Words are runs of other than ASCII white space, A-Z folded. A text of fewer words than a shingle has its
    whole sequence as its one shingle; without words it has none.
    """
    parts, held, size = [], [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= AT_ONCE:
            parts.append(_sets(held, words))
            held, size = [], 0
    parts.append(_sets(held, words))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
