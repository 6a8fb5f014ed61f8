"""How many guesses a password takes: the cheapest way to put it together from guessable parts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np

#: Common words by rank: what passwords are made of, in no corpus's order.
WORDS = tuple(
    """password the you and admin secret love user root test guest login master default changeme welcome letmein
    dragon monkey football baseball qwerty shadow sunshine princess summer winter spring autumn hello hi world
    example sample dummy foobar foo bar token key access database server mysql postgres oracle redis mongo azure cloud
    docker jenkins gitlab github public private system service account manager office company internet computer
    network security passwd pass word temp temporary demo staging production local localhost none null
    true false undefined empty your my this that with from have not for are was but all can her his one our out day
    get has him how man new now old see two way who boy did its let put say she too use dad mom house home work
    school money music happy lucky angel baby batman superman starwars pokemon michael jennifer jordan thomas
    robert daniel jessica charlie andrew matthew ashley george hunter tigger soccer hockey killer pepper ginger
    cookie cheese banana orange purple yellow silver golden black white green blue red flower freedom forever
    trustno iloveyou whatever nothing something anything everything correct horse battery staple insert here
    placeholder redacted removed hidden masked xxxx value string number text enter replace me please""".split()
)

#: Words of English, German, French and Spanish by falling frequency, after the common ones.
MORE_WORDS = tuple((resources.files("lexward.llm") / "data" / "words.txt").read_text("utf-8").split())

_RANK = {word: i + 1 for i, word in reversed(list(enumerate(WORDS + MORE_WORDS)))}
_BEGINNINGS = {word[:i] for word in _RANK for i in range(1, len(word) + 1)}
_LEET = str.maketrans("4@380!17$5+", "aaebolitsst")

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
_AT = {c: (y, x + y / 2) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}

_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2}))\Z")
_YEAR = re.compile(r"(?:19|20)\d\d\Z")

#: A keyboard walk may stop at any of so many characters; beyond them it is a part only as far as it goes.
ANY_WALK = 32


def _next_to(a: str, b: str) -> bool:
    p, q = _AT.get(_SHIFT.get(a, a.lower())), _AT.get(_SHIFT.get(b, b.lower()))
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(text: str) -> int:
    """Characters to choose from at each place, by the kinds that occur in the value."""
    if re.fullmatch(r"[0-9]+", text):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return 16
    size = 0
    for kind, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^a-zA-Z0-9]", 33)):
        size += n if re.search(kind, text) else 0
    return size


def _lower(text: str) -> str:
    """text in lower case, each character still one."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _word_cost(part: str, lower: str, plain: str) -> float | None:
    """lower: part in lower case; plain: the same with letters for the signs that stand for them."""
    rank = _RANK.get(plain)
    if rank is None:
        return None
    extra = 0.0 if lower == plain else 1.0
    if part != lower:
        extra += 1.0 if part[0].isupper() and part[1:] == lower[1:] or part == lower.upper() else sum(c.isupper() for c in part)
    return math.log2(rank + 1) + extra


def _date_cost(part: str) -> float | None:
    if _YEAR.match(part):
        return math.log2(120)
    m = _DATE.match(part) if 4 <= len(part) <= 10 else None
    if not m:
        return None
    year, month, day, sep = (m[1], m[3], m[4], m[2]) if m[1] else (m[8], m[7], m[5], m[6])
    month, day = int(month), int(day)
    if not m[1] and month > 12:
        month, day = day, month
    if not (1 <= month <= 12 and 1 <= day <= 31) or (len(year) == 4 and not 1900 <= int(year) <= 2099):
        return None
    return math.log2(365.0 * (120 if len(year) == 4 else 100)) + (2.0 if sep else 0.0)


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Characters from the places a and b on (or, back, before them) that are the same, for a < b."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = (a - out - (1 << k), b - out - (1 << k)) if back else (a + out, b + out)
        fits = (x >= 0) & (y < len(ranks[k]))
        out += (fits & (ranks[k][np.where(fits, x, 0)] == ranks[k][np.where(fits, y, 0)])) << k
    return out


def repeats(text: str) -> list[tuple[int, int, int]]:
    """(start, end, unit) of every longest stretch in which each character equals the one unit places later, units of any length.

    The stretch has its unit twice at least. Of several units of one stretch the shortest is listed, and those up to four.
    A stretch holds two neighbouring multiples of its unit, from which it is measured both ways by the ranks of
    substrings whose lengths are powers of two: exact, in n log n steps but for texts of nothing but repeats.
    """
    n = len(text)
    ranks = [np.unique(np.fromiter(map(ord, text), np.int64, n), return_inverse=True)[1]]
    while 2 << (k := len(ranks) - 1) <= n:
        last, h = ranks[k], 1 << k
        ranks.append(np.unique(last[:-h] * (n + 1) + last[h:], return_inverse=True)[1])
    found: dict[tuple[int, int], set[int]] = {}
    low = 1
    for k, rank in enumerate(ranks):
        # Of a unit in this range the half, that must agree on one side, is at least 2 to the k.
        units = np.arange(low, min(n // 2, (4 << k) - 2) + 1)
        low = (4 << k) - 1
        counts = (n - 1) // units
        u = np.repeat(units, counts)
        a = (np.arange(len(u)) - np.repeat(np.cumsum(counts) - counts, counts)) * u
        b = a + u
        near = np.zeros(len(u), bool)
        for x, y in ((a, b), (a - (1 << k), b - (1 << k))):
            fits = (x >= 0) & (y < len(rank))
            near |= fits & (rank[np.where(fits, x, 0)] == rank[np.where(fits, y, 0)])
        a, b, u = a[near], b[near], u[near]
        start, end = a - _common(ranks, a, b, True), b + _common(ranks, a, b, False)
        long = end - start >= np.maximum(2 * u, 3)
        for s, e, unit in zip(start[long].tolist(), end[long].tolist(), u[long].tolist()):
            seen = found.setdefault((s, e), set())
            if not seen or unit < min(seen) or unit <= 4:
                seen.add(unit)
    return sorted((s, e, unit) for (s, e), seen in found.items() for unit in seen if unit <= 4 or unit == min(seen))


def _walks(text: str) -> tuple[list[int], list[int]]:
    """For each place where the walk that it lies in ends, and the turns up to it since the text's beginning."""
    n = len(text)
    ends, turns = list(range(1, n + 1)), [0] * n
    way, before = None, None
    for i in range(1, n):
        way = None
        if _next_to(text[i - 1], text[i]):
            p, q = (_AT[_SHIFT.get(c, c.lower())] for c in text[i - 1 : i + 1])
            way = (q[0] - p[0], q[1] - p[1])
        turns[i] = turns[i - 1] + (way is not None and before is not None and way != before)
        before = way
        if way is None:
            ends[i - 1] = -i  # a walk ends here
    end = n
    for i in range(n - 1, -1, -1):
        if ends[i] < 0:
            end = -ends[i]
        ends[i] = end
    return ends, turns


def part_costs(text: str) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of every part of text that is a word, a date, a repeat or a keyboard walk, by start."""
    n, lower = len(text), _lower(text)
    plain = lower.translate(_LEET)
    runs = repeats(text)[::-1] if n else []
    walk_end, turned = _walks(text)
    active: list[tuple[int, int, float]] = []  # the stretches that a lies in: end, unit, bits of the unit
    for a in range(n):
        b = a + 1
        while b <= n and plain[a:b] in _BEGINNINGS:
            cost = _word_cost(text[a:b], lower[a:b], plain[a:b]) if b - a > 1 else None
            if cost is not None:
                yield a, b, cost, "word"
            b += 1
        for b in range(a + 4, min(n, a + 10) + 1) if text[a].isdigit() else ():
            cost = _date_cost(text[a:b])
            if cost is not None:
                yield a, b, cost, "date"
        # A repeat is a unit written over and over, as often as it goes.
        while runs and runs[-1][0] == a:
            _, end, unit = runs.pop()
            active.append((end, unit, unit * math.log2(max(_alphabet(text[a : a + unit]), 2))))
        active = [x for x in active if x[0] - a >= 2 * x[1]]
        for end, unit, bits in active:
            times = (end - a) // unit
            if times * unit >= 3:
                yield a, a + times * unit, bits + math.log2(times), "repeat"
        for b in (*range(a + 3, min(walk_end[a], a + ANY_WALK) + 1), *([walk_end[a]] if walk_end[a] > a + ANY_WALK else [])):
            yield a, b, math.log2(47 * (b - a)) + 2.3 * (1 + turned[b - 1] - turned[a + 1]), "walk"


def segment(text: str) -> tuple[float, list[tuple[str, str]]]:
    """Bits of the cheapest sequence of parts that spells text, and the parts as (kind, part).

    best[i] is the least cost of the first i characters. A part costs what its kind says and one bit more for
    each place it could have; characters in no part are guessed one by one from the value's alphabet. Of equal
    costs the one found first counts: brute force, then parts in the order of part_costs.
    """
    n = len(text)
    if not n:
        return 0.0, []
    single = math.log2(max(_alphabet(text), 2))
    best, back, done = [0.0] + [math.inf] * n, [(0, "")] * (n + 1), 0

    def reach(start: int) -> None:
        """All parts that end at the places up to start have been seen: brute force may be cheaper still."""
        nonlocal done
        while done < start:
            done += 1
            if best[done - 1] + single <= best[done]:
                best[done], back[done] = best[done - 1] + single, (done - 1, "brute")

    for a, b, cost, kind in part_costs(text):
        reach(a)
        if best[a] + (cost + 1.0) < best[b]:
            best[b], back[b] = best[a] + (cost + 1.0), (a, kind)
    reach(n)
    parts, i = [], n
    while i:
        a, kind = back[i]
        if kind == "brute" and parts and parts[-1][0] == "brute":
            parts[-1] = ("brute", text[a:i] + parts[-1][1])
        else:
            parts.append((kind, text[a:i]))
        i = a
    return best[n], parts[::-1]
