"""Suffix sorting of byte strings by induction, with queues that spill to disk.

The types and sorted left-most S suffixes of a text induce its suffix array in two sweeps
over its first characters. A sweep reads suffixes from a queue whose order is first
character, then arrival; as arrivals come in order, a bucket a character, appended to and
read once, is such a priority queue. Buckets over a memory limit are appended to files in
the task's own temporary folder; nothing else reads them, and a task that is run again
makes its own.
All suffixes of a bucket are handled as arrays, so a sweep takes as many array steps as
there are characters and the longest run of one character.

The left-most S suffixes are sorted by naming their substrings, which the same sweeps
sort, and by ranking the string of names by doubling, up to as many names as `depth`
characters can hold: suffixes that agree on more are left in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of queued suffixes kept in memory before they go to files.
QUEUE_BYTES = 64 << 20
_END = 257


class Queue:
    """Positions by first character, in order of arrival."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held, self.folder = limit, 0, None
        self.parts: list[list[np.ndarray]] = [[] for _ in range(_END)]
        self.spilled: set[int] = set()

    def put(self, char: int, positions: np.ndarray) -> None:
        self.parts[char].append(positions)
        self.held += positions.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffix-")
        for char, parts in enumerate(self.parts):
            if parts:
                with open(os.path.join(self.folder.name, str(char)), "ab") as file:
                    for p in parts:
                        p.tofile(file)
                self.spilled.add(char)
                self.parts[char] = []
        self.held = 0

    def take(self, char: int) -> np.ndarray:
        """What has arrived for char since the last call, in order."""
        parts = self.parts[char]
        self.parts[char] = []
        self.held -= sum(p.nbytes for p in parts)
        if char in self.spilled:
            self.spilled.discard(char)
            path = os.path.join(self.folder.name, str(char))
            parts = [np.fromfile(path, np.int32), *parts]
            os.remove(path)
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last character is the smallest and its own kind."""
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), n - 2)
    after = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)
    out[:-1] = step[after] > 0
    return out


def _deal(queue: Queue, text: np.ndarray, positions: np.ndarray) -> None:
    chars = text[positions]
    order = np.argsort(chars, kind="stable")
    positions, chars = positions[order], chars[order]
    first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else []
    for k, at in enumerate(first):
        queue.put(int(chars[at]), positions[at : first[k + 1] if k + 1 < len(first) else len(chars)])


def _sweep(text: np.ndarray, small: np.ndarray, seeds: list[np.ndarray], chars: range, want_small: bool, limit: int) -> list[np.ndarray]:
    """The suffixes of one type, a bucket a character in order of arrival. seeds: of the other type, a bucket a character, in order of the sweep."""
    queue, out = Queue(limit), [np.zeros(0, np.int32)] * _END
    try:
        for c in chars:
            found = []
            batch = queue.take(c)
            while len(batch):
                found.append(batch)
                before = batch[batch > 0] - 1
                _deal(queue, text, before[small[before] == want_small])
                batch = queue.take(c)
            if found:
                out[c] = np.concatenate(found)
            before = seeds[c][seeds[c] > 0] - 1
            if len(before):
                _deal(queue, text, before[small[before] == want_small])
    finally:
        queue.close()
    return out


def _buckets(text: np.ndarray, positions: np.ndarray) -> list[np.ndarray]:
    chars = text[positions]
    order = np.argsort(chars, kind="stable")
    cut = np.searchsorted(chars[order], np.arange(_END + 1))
    return [positions[order[cut[c] : cut[c + 1]]] for c in range(_END)]


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray, limit: int) -> np.ndarray:
    large = _sweep(text, small, _buckets(text, lms), range(_END), False, limit)
    falling = _sweep(text, small, [b[::-1] for b in large], range(_END - 1, -1, -1), True, limit)
    end = np.array([len(text) - 1], np.int32)  # the end mark precedes all
    return np.concatenate([x for c in range(_END) for x in (end if c == 0 else end[:0], large[c], falling[c][::-1] if c else falling[c][:0])])


def suffix_array(data: np.ndarray, depth: int, limit: int = QUEUE_BYTES) -> np.ndarray:
    """The positions of data in the order of their suffixes; those that agree on depth bytes are in any order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32)
    text = np.zeros(n + 1, np.int16)
    text[:-1] = data
    text[:-1] += 1
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    order = _induced(text, small, lms, limit)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    return _induced(text, small, _sorted_lms(text, lms, order, depth), limit)[1:]


def _sorted_lms(text: np.ndarray, lms: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The left-most S suffixes in order. order: by their substrings, which reach to the next of them."""
    m = len(lms)
    number = np.zeros(len(text), np.int32)
    number[lms] = np.arange(m, dtype=np.int32)
    length = np.diff(np.append(lms, len(text) - 1)) + 1
    by = number[order]
    name = np.cumsum(np.concatenate(([False], ~_equal(text, order[1:], order[:-1], length[by[1:]], length[by[:-1]])))).astype(np.int64)
    rank = np.zeros(m, np.int64)
    rank[by] = name + 1
    reach = 1
    while reach < depth // 2 + 1 and rank.max(initial=0) < m:
        later = np.zeros(m, np.int64)
        later[: max(0, m - reach)] = rank[reach:]
        key = rank << 32 | later
        by = np.argsort(key, kind="stable")
        rank[by] = np.cumsum(np.concatenate(([True], key[by[1:]] != key[by[:-1]])))
        reach *= 2
    return lms[np.argsort(rank, kind="stable")]


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n characters from each a are the m characters from b, compared one by one while they are."""
    same = n == m
    left, k = np.flatnonzero(same), 0
    while len(left):
        good = text[a[left] + k] == text[b[left] + k]
        same[left[~good]] = False
        k += 1
        left = left[good]
        left = left[n[left] > k]
    return same


def common_at_least(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the size bytes from each a are those from b; all lie within data."""
    same, left, k = np.zeros(len(a), bool), np.arange(len(a)), 0
    words = np.zeros(len(data), np.uint64)
    for j in range(8):
        words[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(8 * j)
    while k + 8 <= size and len(left):
        left = left[words[a[left] + k] == words[b[left] + k]]
        k += 8
    while k < size and len(left):
        left = left[data[a[left] + k] == data[b[left] + k]]
        k += 1
    same[left] = True
    return same
