"""A minimal acyclic transducer from words to token ids, as one file that many processes map into memory.

States are made from the sorted words: what a word shares with the next one stays open, the
rest is finished from its end, and a finished state that behaves as one before it is that
one, so that common ends of words are there once. Ids stand on the earliest arc from which
on they are certain; where a longer word takes another turn they move further down.

The file holds little-endian numbers: the counts of states, arcs, ids on arcs and ids at
ends, then for each state its first arc, for each arc its target and its first id, for each
state its first id as an end, the ids of both, whether a state is an end, and the arcs' bytes,
which ascend within a state.
"""

from __future__ import annotations

import functools
import mmap
import struct
from array import array

import numpy as np

_HEAD = struct.Struct("<4I")


class Words:
    """Words side by side: their bytes, filled up with zeros, and how many each has."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.zeros((len(words), int(self.size.max(initial=0))), np.uint8)
        self.letters[np.arange(self.letters.shape[1]) < self.size[:, None]] = np.frombuffer(b"".join(words), np.uint8)

    def take(self, which: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.size, out.letters = self.size[which], self.letters[which]
        return out


class _Open:
    """A state that may still get arcs: byte to [target, ids]."""

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.end: tuple | None = None

    def push(self, ids: tuple) -> None:
        """Puts ids before whatever comes from here on."""
        for arc in self.arcs.values():
            arc[1] = ids + arc[1]
        if self.end is not None:
            self.end = ids + self.end


class _Finished:
    """The states that are done, each behaviour once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}

    def add(self, state: _Open) -> int:
        own = (state.end, tuple((b, target, ids) for b, (target, ids) in state.arcs.items()))
        return self.known.setdefault(own, len(self.known))


def _shared(a: bytes | tuple, b: bytes | tuple) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def compiled(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The file of a transducer for words, none of which is empty."""
    done, path, last = _Finished(), [_Open()], b""
    for word in sorted(words):
        ids, common = words[word], _shared(word, last)
        for k in range(len(last), common, -1):
            path[k - 1].arcs[last[k - 1]][0] = done.add(path.pop())
        for k in range(common):
            arc = path[k].arcs[word[k]]
            same = _shared(arc[1], ids)
            if same < len(arc[1]):
                path[k + 1].push(arc[1][same:])
                arc[1] = arc[1][:same]
            ids = ids[same:]
        for k in range(common, len(word)):
            path[k].arcs[word[k]] = [None, ids if k == common else ()]
            path.append(_Open())
        path[-1].end = ()
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[last[k - 1]][0] = done.add(path.pop())
    done.add(path[0])  # the start comes last
    first, target, ids_at, end_at, arc_ids, end_ids, ends, label = array("I"), array("I"), array("I"), array("I"), array("I"), array("I"), bytearray(), bytearray()
    for end, arcs in done.known:
        first.append(len(label))
        end_at.append(len(end_ids))
        ends.append(end is not None)
        end_ids.extend(end or ())
        for byte, to, ids in arcs:
            label.append(byte)
            target.append(to)
            ids_at.append(len(arc_ids))
            arc_ids.extend(ids)
    first.append(len(label)), end_at.append(len(end_ids)), ids_at.append(len(arc_ids))
    head = _HEAD.pack(len(done.known), len(label), len(arc_ids), len(end_ids))
    return head + b"".join(x.tobytes() for x in (first, target, ids_at, end_at, arc_ids, end_ids)) + bytes(ends) + bytes(label)


class Transducer:
    """A compiled file, mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.states, n_arcs, on_arcs, on_ends = _HEAD.unpack_from(self.map)
        at, cut = _HEAD.size, []
        for kind, n in (("<u4", self.states + 1), ("<u4", n_arcs), ("<u4", n_arcs + 1), ("<u4", self.states + 1), ("<u4", on_arcs + on_ends), ("u1", self.states), ("u1", n_arcs)):
            cut.append(np.frombuffer(self.map, kind, n, at))
            at += cut[-1].nbytes
        first, self.target, self.ids_at, end_at, self.ids, self.ends, label = cut
        self.end_at = end_at.astype(np.int64) + on_arcs  # ids at ends follow those on arcs
        self.arcs = np.repeat(np.arange(self.states), np.diff(first.astype(np.int64))) << 8 | label

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are in the lexicon, how many ids each of these has, their ids); all words take a step at a time."""
        state, there = np.full(len(words.size), self.states - 1), np.ones(len(words.size), bool)
        begin, count = (np.zeros((len(words.size), words.letters.shape[1] + 1), np.int64) for _ in range(2))
        for step in range(words.letters.shape[1]):
            on = np.flatnonzero(there & (words.size > step))
            wanted = state[on] << 8 | words.letters[on, step]
            arc = np.searchsorted(self.arcs, wanted)
            hit = arc < len(self.arcs)
            hit[hit] = self.arcs[arc[hit]] == wanted[hit]
            there[on[~hit]] = False
            on, arc = on[hit], arc[hit]
            state[on] = self.target[arc]
            begin[on, step] = self.ids_at[arc]
            count[on, step] = self.ids_at[arc + 1] - begin[on, step]
        there &= self.ends[state].astype(bool)
        begin[:, -1] = self.end_at[state]
        count[:, -1] = self.end_at[state + 1] - begin[:, -1]
        begin, count = begin[there].ravel(), count[there]
        total, flat = count.sum(axis=1), count.ravel()
        place = np.repeat(begin - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())
        return there, total, self.ids[place]


@functools.lru_cache(maxsize=2)
def mapped(path: str) -> Transducer:
    """One mapping a worker process; the pages are the machine's."""
    return Transducer(path)
