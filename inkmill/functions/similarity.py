"""How much of two token lists is in matching blocks, the longest block first, then what is left and right of it.

The longest block of two stretches comes from a suffix automaton of one of them, through which
the other is read once, so that the work grows with the stretches and not with their
product. Of blocks as long as each other the one that is first in the first list counts, and then in
the second. In second lists of POPULAR_FROM tokens and more, a token that makes up more than about
a hundredth of them is popular: it starts no block, but blocks are carried on over it.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Fixed value: tokens of the second list from which on there are popular ones.
POPULAR_FROM = 200
#: A token that no block can hold.
_NONE = -1


class _Automaton:
    """The stretches of codes between those that are _NONE: states with their successors, their suffix, their length and where they end first."""

    def __init__(self, codes: list[int], low: int, high: int):
        self.after: list[dict[int, int]] = [{}]
        self.suffix, self.size, self.end = [-1], [0], [-1]
        state = 0
        for at in range(low, high):
            state = 0 if codes[at] == _NONE else self._grown(state, codes[at], at)

    def _state(self, after: dict[int, int], suffix: int, size: int, end: int) -> int:
        self.after.append(after), self.suffix.append(suffix), self.size.append(size), self.end.append(end)
        return len(self.size) - 1

    def _split(self, state: int, code: int, size: int) -> int:
        """The state that code leads to, or, if that also stands for longer strings, one taken out of it."""
        to = self.after[state][code]
        if self.size[to] == size:
            return to
        own = self._state(dict(self.after[to]), self.suffix[to], size, self.end[to])
        self.suffix[to] = own
        while state >= 0 and self.after[state].get(code) == to:
            self.after[state][code] = own
            state = self.suffix[state]
        return own

    def _grown(self, last: int, code: int, at: int) -> int:
        """The state of the stretch that ends at `at`, which is last's with the code added."""
        if code in self.after[last]:
            return self._split(last, code, self.size[last] + 1)
        new = self._state({}, 0, self.size[last] + 1, at)
        while last >= 0 and code not in self.after[last]:
            self.after[last][code] = new
            last = self.suffix[last]
        if last >= 0:
            self.suffix[new] = self._split(last, code, self.size[last] + 1)
        return new

    def longest(self, codes: list[int], low: int, high: int) -> tuple[int, int, int]:
        """(start in codes, start in the automaton's list, length) of the longest common block; the length is 0 if there is none."""
        state = run = 0
        best = (low, 0, 0)
        for at in range(low, high):
            code = codes[at]
            while state and code not in self.after[state]:
                state = self.suffix[state]
                run = self.size[state]
            if code == _NONE or code not in self.after[state]:
                state = run = 0
                continue
            state, run = self.after[state][code], run + 1
            if run > best[2]:
                best = (at - run + 1, self.end[state] - run + 1, run)
        return best


def matching(a: list[str], b: list[str]) -> int:
    """How many tokens are in matching blocks."""
    counts = Counter(b)
    popular = {t for t, n in counts.items() if n > len(b) // 100 + 1} if len(b) >= POPULAR_FROM else set()
    code = {t: k for k, t in enumerate(t for t in counts if t not in popular)}
    first, second = [code.get(t, _NONE) for t in a], [code.get(t, _NONE) for t in b]
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_low, a_high, b_low, b_high = open_.pop()
        i, j, n = _Automaton(second, b_low, b_high).longest(first, a_low, a_high)
        if not n:
            i, j = a_low, b_low
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < a_high and j + n < b_high and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            open_ += [x for x in ((a_low, i, b_low, j), (i + n, a_high, j + n, b_high)) if x[0] < x[1] and x[2] < x[3]]
    return total


def similarity(a: str | None, b: str | None) -> float:
    """Twice the tokens in matching blocks over all tokens of both; 1 where there are none."""
    first, second = (a or "").split(), (b or "").split()
    n = len(first) + len(second)
    return 2 * matching(first, second) / n if n else 1.0


@pandas_udf(DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity(a, b) of texts; null counts as empty. Blocks depend on the blocks found before, which has no built-in form."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
