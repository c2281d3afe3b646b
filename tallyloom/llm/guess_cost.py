"""How many guesses a password stands: the cheapest way to cut it into words, dates, repeats, keyboard walks and rest.

Costs are decimal logarithms of guesses and add up over segments; each segment pays for the choice of its kind. The
dynamic program goes once over the value: a segment of each pattern that ends at a place competes with one more
character of brute force, whose spans pay their kind once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from math import log10

#: The choice among five kinds of segments.
KIND = log10(5)
#: Rows of a keyboard from the left, how far each is shifted to the right in half keys, and shifted signs.
KEY_ROWS = (("`1234567890-=", 0), ("qwertyuiop[]\\", 3), ("asdfghjkl;'", 4), ("zxcvbnm,./", 5))
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
#: Signs that stand for letters.
SIGNS_FOR = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
LONGEST_WORD, LONGEST_UNIT = 24, 8
DATE = re.compile(r"(?=(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2})))")
YEAR = re.compile(r"(?=((?:19|20)\d\d))")
REPEAT = re.compile(rf"(.{{1,{LONGEST_UNIT}}}?)\1+", re.DOTALL)
TODAY = 2000


def _places() -> dict[str, tuple[int, int]]:
    return {c: (2 * i + shift, y) for y, (row, shift) in enumerate(KEY_ROWS) for i, c in enumerate(row)}


PLACES = _places()


def words_by_rank(tokens: list[bytes]) -> dict[str, int]:
    """The words among tokens that are listed by falling frequency, lower-cased, with their first place (from 1)."""
    ranks: dict[str, int] = {}
    for place, token in enumerate(tokens, 1):
        word = token.decode("utf-8", "replace").strip().lower()
        if 3 <= len(word) <= LONGEST_WORD and word.isascii() and word.isalpha():
            ranks.setdefault(word, place)
    return ranks


def _brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _word_segments(value: str, ranks: dict[str, int]) -> list[tuple[int, int, float]]:
    low, out = value.lower(), []
    plain = "".join(SIGNS_FOR.get(c, c) for c in low)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + LONGEST_WORD) + 1):
            own = ranks.get(low[i:j])
            rank, signs = (own, 0) if own else (ranks.get(plain[i:j]), sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True)))
            if rank:
                part = value[i:j]
                upper = sum(c.isupper() for c in part)
                cased = 0.0 if not upper else log10(2) if upper == len(part) or (upper == 1 and (part[0].isupper() or part[-1].isupper())) else upper * log10(2) + log10(len(part))
                out.append((i, j, log10(rank + 1) + cased + signs * log10(2)))
    return out


def _date_segments(value: str) -> list[tuple[int, int, float]]:
    out = [(m.start(), m.start() + 4, log10(max(abs(int(m[1]) - TODAY), 20))) for m in YEAR.finditer(value)]
    for m in DATE.finditer(value):
        year, sign, parts = (m[1], m[2], (m[3], m[4])) if m[1] else (m[8], m[6], (m[5], m[7]))
        a, b = map(int, parts)
        full = int(year) + (0 if len(year) == 4 else 1900 if int(year) > 50 else TODAY)
        if 1900 <= full <= 2100 and min(a, b) >= 1 and min(a, b) <= 12 and max(a, b) <= 31:
            size = len(year) + len(parts[0]) + len(parts[1]) + 2 * len(sign)
            out.append((m.start(), m.start() + size, log10(365 * max(abs(full - TODAY), 20)) + (log10(4) if sign else 0.0)))
    return out


def _walk_segments(value: str) -> list[tuple[int, int, float]]:
    """Longest stretches of three characters or more that go by neighbouring keys, or up or down by one code."""
    out, keys = [], [PLACES.get(SHIFTED.get(c, c.lower())) for c in value]

    def stretches(step):
        i = 0
        while i < len(value) - 1:
            j, way, turns = i, None, 0
            while j + 1 < len(value) and (now := step(j)) is not None:
                turns += now != way
                way, j = now, j + 1
            if j - i >= 2:
                yield i, j + 1, turns
            i = max(j, i + 1)

    def key_step(i):
        a, b = keys[i], keys[i + 1]
        return (b[0] - a[0], b[1] - a[1]) if a and b and a != b and abs(b[0] - a[0]) <= 3 and abs(b[1] - a[1]) <= 1 else None

    def code_step(i):
        d = ord(value[i + 1]) - ord(value[i])
        return d if abs(d) == 1 and value[i].isalnum() and value[i + 1].isalnum() else None

    for i, j, turns in stretches(key_step):
        upper = sum(c.isupper() or c in SHIFTED for c in value[i:j])
        out.append((i, j, log10(len(PLACES)) + log10(j - i) + turns * log10(5) + (0 if not upper else log10(2) if upper == j - i else upper * log10(2))))
    out += [(i, j, log10(26) + log10(j - i) + (turns - 1) * log10(2)) for i, j, turns in stretches(code_step)]
    return out


def _repeat_segments(value: str, ranks: dict[str, int]) -> list[tuple[int, int, float]]:
    return [(m.start(), m.end(), guess_cost(m[1], ranks, repeats=False) + log10(len(m[0]) // len(m[1]))) for m in REPEAT.finditer(value) if len(m[0]) >= 3]


def guess_cost(value: str, ranks: dict[str, int], repeats: bool = True) -> float:
    """The least sum of segment costs over all ways to cut value: the decimal logarithm of guesses; 0 for an empty one."""
    ending = defaultdict(list)
    for i, j, cost in _word_segments(value, ranks) + _date_segments(value) + _walk_segments(value) + (_repeat_segments(value, ranks) if repeats else []):
        ending[j].append((i, cost))
    best, rough = [0.0], [float("inf")]  # cheapest at each place, and cheapest whose last segment is brute force
    for j, c in enumerate(value, 1):
        rough.append(min(rough[-1], best[-1] + KIND) + _brute(c))
        best.append(min([rough[-1], *(best[i] + cost + KIND for i, cost in ending[j])]))
    return best[-1]
