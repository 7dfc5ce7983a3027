"""String helpers shared by the operators of this subpackage (plain Python, run in Arrow batches)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import xxhash

#: Characters that scanners confuse, brought to one letter, and respelled sounds.
LOOKALIKES = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "6": "g", "2": "z", "!": "l", "|": "l"})
SOUNDS = (("rn", "m"), ("ee", "i"), ("oo", "u"), ("w", "v"), ("y", "i"), ("vv", "v"))


def plain(s: str) -> str:
    """Lower case without accents, in compatibility form."""
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


@lru_cache(200_000)
def sounds_like(token: str) -> str:
    """A token with lookalikes and common respellings undone; used only to compare."""
    t = token.translate(LOOKALIKES) if re.search(r"[a-z]", token) else token
    for a, b in SOUNDS:
        t = t.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", t)


def distance(a: str, b: str, limit: int = 3) -> int:
    """Optimal string alignment distance (edits and swaps of neighbours), or ``limit + 1`` if larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # Strip what both share at the ends: typed variants differ in the middle.
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        row = [x] + [0] * len(b)
        for y in range(1, len(b) + 1):
            cost = a[x - 1] != b[y - 1]
            row[y] = min(last[y] + 1, row[y - 1] + 1, last[y - 1] + cost)
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                row[y] = min(row[y], before[y - 2] + 1)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def near(a: str, b: str, edits: int) -> bool:
    """Within ``edits`` as written, or with lookalikes and sounds undone."""
    return distance(a, b, edits) <= edits or distance(sounds_like(a), sounds_like(b), edits) <= edits


def grams(tokens: list[str], n: int = 3) -> list[str]:
    """Distinct character n-grams of each token with its ends marked."""
    out: dict[str, None] = {}
    for t in tokens:
        t = f"^{t}$"
        for i in range(max(1, len(t) - n + 1)):
            out[t[i : i + n]] = None
    return list(out)


#: Longer strings are keyed by segments: what is left without two characters grows with the square of the length.
LONG = 40


def _edit_keys(s: str, edits: int) -> set[str]:
    out: set[str] = set()
    if len(s) <= LONG + 2:
        out, last = {s}, {s}
        for _ in range(edits):
            last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
            out |= last
    if len(s) > LONG:
        # Two edits or swaps touch at most four of five segments, and move the fifth by at most two places.
        for n in range(len(s) - 2, len(s) + 3):
            for i in range(5):
                lo, hi = i * n // 5, (i + 1) * n // 5
                out |= {f"{n}.{i}.{s[lo + d : hi + d]}" for d in range(-2, 3) if lo + d >= 0}
    return out


def edit_keys(s: str, two_from: int) -> set[int]:
    """Strings that ``near`` accepts share a key: within one edit, or two if both have at least ``two_from`` letters."""
    edits = 2 if len(s) >= two_from else 1
    keys = _edit_keys(s, edits) | {f"~{k}" for k in _edit_keys(sounds_like(s), edits)}
    return {xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys}
