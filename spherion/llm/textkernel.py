"""Vectorised word arithmetic on the bytes of an Arrow batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash, and the constants of the finaliser of splitmix64.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Bytes whose words are hashed at once.
SEGMENT = 256 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, size: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; one longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; text k has the words first[k] to first[k + 1] - 1.

    ``word_bytes`` marks the bytes of words (256 flags); by default all but ASCII white space.
    """
    inside = ~_SPACE[raw] if word_bytes is None else word_bytes[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SEGMENT + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands.

    ``starts`` may overlap their predecessors' words but must rise.  Bytes are taken in segments of whole words, so
    the tables of powers stay small however long the text is.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT)))
        low, high = int(starts[at]), int(ends[at:to].max())
        up, down = _powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries (of the whole array; the caller masks what crosses texts)."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : k + len(out)]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive entries."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
