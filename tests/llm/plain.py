"""Brute-force versions of the operators in plain Python."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "\x20\t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def components(docs: list[tuple], size: int, percent: int) -> dict:
    """Smallest id that links reach, for rows (id, text) with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def quality(text: str | None, least: int = 5, longest: int = 50) -> tuple:
    """(n_words, n_repeat_words, base_failed, kept)."""
    words = WORD.findall(text or "")

    def places(n):
        found: dict = {}
        for i in range(len(words) - n + 1):
            found.setdefault(tuple(words[i : i + n]), []).append(i)
        return [p for ps in found.values() if len(ps) > 1 for p in ps]

    covered = {i + k for i in places(least) for k in range(least)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), len(covered), failed, not failed and not places(longest + 1)


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(LOWER)


def drop_lines(texts: list[str | None], least: int) -> list[tuple[int, int, str]]:
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in lines for k in {line_key(x) for x in ls} if k)
    out = []
    for ls in lines:
        kept = [x for x in ls if seen[line_key(x)] < least]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def plain_words(text: str | None) -> list[str]:
    return [w for w in re.split(r"(?:[^\w]|_)+", (text or "").lower()) if w]


def bag(words: list[str], size: int) -> Counter:
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def leaks(text: str | None, item: str | None, percent: int = 80) -> float:
    """Largest similarity of a window as long as the item; 0 below the limit."""
    words, other = plain_words(text), plain_words(item)
    if not words or not other:
        return 0.0
    k = min(5, len(other))
    if len(words) < k:
        return 0.0
    target, best = bag(other, k), 0.0
    for start in range(max(1, len(words) - len(other) + 1)):
        best = max(best, similarity(bag(words[start : start + len(other)], k), target))
    return best if 100 * best >= percent - 1e-9 else 0.0
