"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of anything but U+0020 and U+0009 to U+000D, with A-Z lower-cased;
a shingle is five words in a row, or all words of a text that has fewer.
Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Text is worked on in blocks of about so many bytes and rows at most, so that the arrays stay small.
BLOCK_BYTES, BLOCK_ROWS = 512 << 10, 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MULT = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of h over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, where each row starts and the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for low in range(0, len(column), BLOCK_ROWS):  # so that no copy of a whole batch is made
        part = column.slice(low, BLOCK_ROWS).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        starts = np.frombuffer(offsets, np.int64, len(part) + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
            yield low + at, low + to, raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at]
            at = to


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends; words don't cross rows."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    first = inside[1:-1] & (~inside[:-2] | fresh[:-1])
    last = inside[1:-1] & (~inside[2:] | fresh[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end)."""
    begin, end = word_spans(raw, starts)
    return span_hashes(raw, begin, end), np.searchsorted(begin, starts)


def row_shingles(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in text order, first shingle of each row and the end)."""
    words, at = word_hashes(raw, starts)
    n = np.diff(at)
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : k + len(rolled)] * _MULT[k]
    rolled = mix(rolled)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(out_at[-1], np.uint64)
    row = np.repeat(np.arange(len(n)), count)
    take = at[:-1][row] + np.arange(len(out)) - out_at[:-1][row]
    whole = n[row] >= SHINGLE
    out[whole] = rolled[take[whole]]
    for r in short:  # at most four words each
        own = words[at[r] : at[r + 1]]
        out[out_at[r]] = mix(np.array([(own * _MULT[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, out_at


def row_runs(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words, fewer than SHINGLE, in text order, its row): as row_shingles has it for a text of these words."""
    words, at = word_hashes(raw, starts)
    total = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        total += words[k : k + len(total)] * _MULT[k]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = row[: len(total)] == row[width - 1 :][: len(total)]
    return mix(total[whole]), row[: len(total)][whole]


def row_sets(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted within it, and where each row's begin."""
    hashes, at = row_shingles(raw, starts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    hashes, row = hashes[order], row[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
        hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(at)))


def set_signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
