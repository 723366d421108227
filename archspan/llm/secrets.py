"""Secret scans by patterns and by token efficiency.

Three patterns give the base spans. The token-efficiency test adds spans: a run
of key-like characters that a tiktoken vocabulary can only cut into short
tokens (few characters per token) is a random string, unless it has the shape
of a known digest or of an identifier.

Cases: null text is empty text; empty text has no span; very long texts are
scanned whole; spans that start together are told in the order of kinds, and a
random string that overlaps a base span is none; repeated rows give repeated
results; an empty table gives an empty result; columns other than doc_id and
text are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# The contract's patterns, kinds in their order, and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Method parameters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
MAX_CHARS_PER_TOKEN = 2.0
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|(?:[a-z]{2,}|[A-Z][a-z]{2,})(?:[A-Z][a-z]{2,})+)"  # lower, upper, Capitalised, camelCase of longer words
IDENTIFIER = re.compile(
    r"(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUID
    r"|[0-9_+/=-]+"  # numbers, dates, rules
    rf"|{WORD}(?:[_/-]{WORD})*[_/-]?[0-9]{{0,6}}"  # words, also joined, with a number behind
    r")\Z"
)


@lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """A tiktoken encoding of a public vocabulary file; path is a parameter."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns; leftmost non-overlapping per kind, then the short ones dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:  # a run that is too short from its first AKIA is too short from any later one
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], most: float = MAX_CHARS_PER_TOKEN, path: str | None = None) -> list[tuple[int, int, int]]:
    """Spans that the token-efficiency test adds; none overlaps a base span."""
    out = []
    ends = list(accumulate((e for _, _, e in taken), max))  # so the base spans before an index end by there
    for m in RUN.finditer(text):
        s, e = m.span()
        i = bisect_left(taken, (e, -1, -1))  # base spans from here on start behind the run
        if i and ends[i - 1] > s or DIGEST.match(m[0]) or IDENTIFIER.match(m[0]):
            continue
        if (e - s) / len(encoder(path).encode_ordinary(m[0])) < most:
            out.append((s, 3, e))
    return out


def spans(text: str | None, most: float = MAX_CHARS_PER_TOKEN, path: str | None = None):
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, most, path))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, most: float = MAX_CHARS_PER_TOKEN, path: str | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_random: one row for each row of docs, without a shuffle."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base, every = spans(text, most, path)
                n = [sum(k == x for _, x, _ in every) for k in range(4)]
                out.append((*n[:3], hashlib.sha256(written(base).encode()).hexdigest(), written(every), n[3]))
            yield pd.concat(
                [pdf[["doc_id"]], pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"], index=pdf.index)], axis=1
            )

    schema = "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return common.typed(common.texts(docs).mapInPandas(rows, schema), docs)


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with each found secret replaced; of an assignment only the value goes."""
    if not text:
        return text
    _, every = spans(text)
    out, at = [], 0
    for s, k, e in every:
        if k == 0:
            s = ASSIGN.match(text, s).start(2)
        if e <= at:
            continue
        out += [text[at : max(s, at)], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text; n_chars, where there is such a column, follows the new text; other columns stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [redacted(t) for t in b.column("text").to_pylist()]
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, b.schema.field("text").type))
            if "n_chars" in b.schema.names:
                sizes = pa.array([None if t is None else len(t) for t in new], b.schema.field("n_chars").type)
                b = b.set_column(b.schema.get_field_index("n_chars"), "n_chars", sizes)
            yield b

    return docs.mapInArrow(rows, docs.schema)
