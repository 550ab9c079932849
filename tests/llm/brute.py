"""Plain versions of the operators, to test against."""

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m.group()))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()


def words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def repeated_bytes(rows: list[tuple[int, str | None]], size: int = 100) -> dict[int, list[bool]]:
    """For each document, which bytes a string of this size that starts earlier covers."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - size + 1):
            s = raw[k : k + size]
            if s in seen:
                gone[k : k + size] = [True] * size
            seen.add(s)
        out[i] = gone
    return out
