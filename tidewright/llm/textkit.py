"""Shared text primitives: word rules, and NumPy views of Arrow string columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The white space that separates words: a space and the controls from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

#: UTF-8 bytes of text that one NumPy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 21

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly the six characters of SPACE."""
    return text.encode().split() if text else []


_BLANK = re.compile(rb"[ \t-\r]")


def hashed_words(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """XXH64 of each word of a text; its words exist as objects for one piece of the text at a time."""
    out, at = [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + piece) if at + piece < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hashed_words() of consecutive rows, and the first word of each row (one entry more than rows)."""
    whole = raw.tobytes()
    rows = [hashed_words(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    of = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint64)), of


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step_bytes, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and the first word of each row (one entry more than rows)."""
    solid = ~_IS_SPACE[raw]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[edge] |= solid[edge]
    closes[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)[:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
    within = at - np.repeat(starts, lengths)
    weight = powers(0x9E3779B97F4A7C15 | 1, int(lengths.max()))
    sums = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * weight[within], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
