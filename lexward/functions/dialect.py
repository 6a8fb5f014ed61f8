r"""Translation of the patterns' regular-expression dialect into the one that Spark runs.

Patterns are written for a linear-time engine in Unicode mode: \s, \w, \d and \b know all of Unicode, case
folding is simple and never joins i with dotless or dotted capitals, '.' stops at line feeds only. Java's
engine differs in each of these, so a pattern is parsed and written anew; what can't be carried over
faithfully is refused.
"""

from __future__ import annotations

import bisect
import functools
import sys
from dataclasses import dataclass, replace


class DialectError(ValueError):
    """The pattern isn't valid in its dialect, or has no faithful counterpart."""


#: Unicode classes, and '.' that stops at line feeds only.
FLAGS = "(?Ud)"

_META = set("\\^$.|?*+()[]{}")
_PERL = {"s", "S", "w", "W", "d", "D"}
_CONTROL = {"n": 0x0A, "t": 0x09, "r": 0x0D, "f": 0x0C, "v": 0x0B, "a": 0x07, "0": None}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t\\x20", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": "\\x20-~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r\\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}

#: Groups within groups, as the dialect's own engine has it; and a repetition's bounds, as Java's has them. The former engine
#: refuses patterns by what they compile to instead, so longer repetitions are accepted here than there.
_DEEPEST = 250
_MOST_TIMES = 2**31 - 1

#: Texts that a gate looks for, at most, and a gate text's characters; more are of no use.
_MOST_TEXTS = 32
_LONGEST_TEXT = 64


@functools.cache
def _folds() -> dict[str, tuple[str, ...]]:
    """For each character that has case the others of its simple fold."""
    groups: dict[str, list[str]] = {}
    for code in range(0x20000):
        c = chr(code)
        folded = "ß" if c == "ẞ" else c.casefold()
        if len(folded) == 1 and not 0xD800 <= code < 0xE000:
            groups.setdefault(folded, []).append(c)
    return {c: tuple(x for x in group if x != c) for group in groups.values() if len(group) > 1 for c in group}


def _others(c: str) -> tuple[str, ...]:
    return _folds().get(c, ())


@functools.cache
def _cased() -> list[str]:
    """Characters that have others in their fold, in order: some 2,800."""
    return sorted(_folds())


def _quoted(c: str) -> str:
    return c if c.isascii() and c.isalnum() or c == "_" else f"\\x{{{ord(c):X}}}"


def fold(c: str) -> str | None:
    """A character as lines are folded for the gates: in lower case; None if there is no telling."""
    if c in "ſK":
        return "s" if c == "ſ" else "k"
    if c.isascii():
        return c.lower()
    return c if c.lower() == c == c.upper() and c not in _folds() else None


@dataclass(frozen=True)
class _Node:
    """A piece of a pattern: Java's spelling, and what is known of every text that it matches, folded.

    exact: the one text that it matches; else head and tail: how each begins and ends; need: texts of which each holds one.
    """

    java: str
    exact: str | None = None
    head: str = ""
    tail: str = ""
    need: frozenset[str] = frozenset()

    def needed(self) -> frozenset[str]:
        """The texts to look for; none where nothing is known."""
        if self.exact is not None:
            return frozenset({self.exact}) if self.exact else frozenset()
        return _better(self.need, *(frozenset({t}) for t in (self.head, self.tail) if t))


def _better(*options: frozenset[str]) -> frozenset[str]:
    """Of sets of texts the one that tells most: long texts, and few."""
    known = [o for o in options if o and len(o) <= _MOST_TEXTS]
    return max(known, key=lambda o: (min(map(len, o)), -len(o), sorted(o)), default=frozenset())


def _sequence(nodes: list[_Node]) -> _Node:
    java = "".join(n.java for n in nodes)
    if all(n.exact is not None for n in nodes):
        exact = "".join(n.exact for n in nodes)
        if len(exact) <= _LONGEST_TEXT:
            return _Node(java, exact)
    options, run, head = [], "", None
    for n in nodes:
        if n.exact is not None:
            run += n.exact
            continue
        options += [frozenset({run + n.head}) if run + n.head else frozenset(), n.need]
        head = run + n.head if head is None else head
        run = n.tail
    options.append(frozenset({run}) if run else frozenset())
    return _Node(java, None, (run if head is None else head)[:_LONGEST_TEXT], run[-_LONGEST_TEXT:], _better(*options))


def _either(branches: list[_Node]) -> _Node:
    if len(branches) == 1:
        return branches[0]
    java = "|".join(b.java for b in branches)
    needs = [b.needed() for b in branches]
    return _Node(java, None, "", "", _better(frozenset().union(*needs)) if all(needs) else frozenset())


def _times(node: _Node, java: str, low: int, high: int | None) -> _Node:
    """node from low to high times."""
    if low == high and node.exact is not None and len(node.exact) * low <= _LONGEST_TEXT:
        return _Node(java, node.exact * low)
    if low == 0:
        return _Node(java)
    edge = node.exact if node.exact is not None else ""
    return _Node(java, None, edge or node.head, edge or node.tail, node.needed())


class _Parser:
    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold, self.names = text, 0, fold, set()

    def fail(self, why: str):
        raise DialectError(f"{why} at {self.at} in {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            self.fail("the pattern ends too early")
        self.at += n
        return out

    def alternation(self, depth: int = 0) -> _Node:
        if depth > _DEEPEST:
            self.fail("groups are nested too deep")
        fold, branches, nodes = self.fold, [], []
        while self.at < len(self.text) and self.peek() != ")":
            if self.peek() == "|":
                self.take()
                branches.append(_sequence(nodes))
                nodes = []
                continue
            nodes.append(self.repeated(depth))
        self.fold = fold  # a flag set inside lasts to the end of its group
        return _either([*branches, _sequence(nodes)])

    def repeated(self, depth: int) -> _Node:
        atom, can = self.atom(depth)
        times = 0
        while self.peek() and (self.peek() in "*+?" or self.peek() == "{"):
            if not can:
                self.fail("nothing to repeat")
            mark = self.take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(mark, (0, 0))
            if mark == "{":
                body = self.text[self.at :].split("}", 1)
                low, comma, high = body[0].partition(",")
                low, high = low.strip(), high.strip()
                if len(body) < 2 or not low.isascii() or not low.isdigit() or (high and not (high.isascii() and high.isdigit())):
                    self.fail("a repetition isn't well formed")
                if high and int(high) < int(low) or max(int(low), int(high or 0)) > _MOST_TIMES:
                    self.fail("a repetition's bounds are out of range")
                self.at += len(body[0]) + 1
                mark = "{" + low + comma + high + "}"
                least, most = int(low), int(high) if high else None if comma else int(low)
            lazy = self.take() if self.peek() == "?" else ""
            # A second mark repeats the repetition; Java would read it as possessive.
            atom = _times(atom, (f"(?:{atom.java})" if times else atom.java) + mark + lazy, least, most)
            times += 1
        return atom

    def atom(self, depth: int) -> tuple[_Node, bool]:
        c = self.take()
        if c == "(":
            return self.group(depth)
        if c == "[":
            return self.bracket(), True
        if c == "\\":
            return self.escape()
        if c == "^":
            return _Node("^", ""), True
        if c == "$":
            return _Node("\\z", ""), True
        if c == ".":
            return _Node("."), True
        if c in "*+?":
            self.at -= 1
            self.fail("nothing to repeat")
        if c == "{":
            self.fail("nothing to repeat")
        return self.literal(c), True

    def literal(self, c: str) -> _Node:
        others = _others(c) if self.fold else ()
        return _Node("[" + "".join(map(_quoted, (c, *others))) + "]" if others else _quoted(c), fold(c))

    def group(self, depth: int) -> tuple[_Node, bool]:
        start, before = "(", self.fold
        if self.peek() == "?":
            self.take()
            if self.peek(2) in ("P<",) or (self.peek() == "<" and self.peek(2) not in ("<=", "<!")):
                self.at = self.text.index("<", self.at) + 1
                name, closed, _ = self.text[self.at :].partition(">")
                if not closed or not name.isascii() or not name.replace("_", "a").isalnum() or name[0].isdigit() or name in self.names:
                    self.fail("a group's name isn't valid")
                self.names.add(name)
                self.at += len(name) + 1
                # Names are never used, and Java's may not hold underscores.
                start = "("
            else:
                on, flags = True, {}
                while (c := self.take()) not in ":)":
                    if c == "-" and on:
                        on = False
                    elif c in "ims":
                        flags[c] = on
                    else:
                        self.fail("look-around, atomic groups and this flag aren't supported")
                if c == ")" and not flags or not on and not flags:
                    self.fail("a group of flags is empty")
                self.fold = flags.pop("i", self.fold)
                rest = "".join(k for k, v in flags.items() if v) + ("-" + "".join(k for k, v in flags.items() if not v) if not all(flags.values()) else "")
                if c == ")":
                    return _Node(f"(?{rest})" if rest else "", ""), False
                start = f"(?{rest}:"
        inside = self.alternation(depth + 1)
        if self.peek() != ")":
            self.fail("a group isn't closed")
        self.take()
        self.fold = before
        return replace(inside, java=start + inside.java + ")"), True

    def code(self) -> int:
        """The rest of \\x, \\u or \\U."""
        size = {"x": 2, "u": 4, "U": 8}[self.text[self.at - 1]]
        if self.peek() == "{":
            digits, closed, _ = self.text[self.at + 1 :].partition("}")
            self.at += len(digits) + 2
            if not closed:
                self.fail("a code isn't closed")
        else:
            digits = self.take(size)
        try:
            value = int(digits, 16) if digits.isalnum() else -1
        except ValueError:
            value = -1
        if not 0 <= value <= 0x10FFFF or 0xD800 <= value < 0xE000:
            self.fail("a code isn't a character")
        return value

    def property(self, negated: bool) -> str:
        if self.peek() == "{":
            name, closed, _ = self.text[self.at + 1 :].partition("}")
            self.at += len(name) + 2
            if not closed:
                self.fail("a property isn't closed")
        else:
            name = self.take()
        if name not in ("L", "Lu", "Ll", "Lt", "Lm", "Lo", "M", "Mn", "Mc", "Me", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "S", "Sm", "Sc", "Sk", "So", "Z", "Zs", "Zl", "Zp", "Cc", "Cf"):
            self.fail("this property isn't supported")
        if self.fold and name in ("Lu", "Ll", "Lt"):
            self.fail("a property of case can't be folded")
        return ("\\P{" if negated else "\\p{") + name + "}"

    def escape(self) -> tuple[_Node, bool]:
        c = self.take()
        if c in _PERL:
            return _Node("\\" + c), True
        if c in "bB":
            if self.peek() == "{":
                self.fail("this boundary isn't supported")
            return _Node("\\" + c, ""), True
        if c == "A":
            return _Node("\\A", ""), True
        if c == "z":
            return _Node("\\z", ""), True
        if c in "pP":
            return _Node(self.property(c == "P")), True
        return self.literal(self.escaped(c)), True

    def escaped(self, c: str) -> str:
        if c in "xuU":
            return chr(self.code())
        if c in _CONTROL and _CONTROL[c] is not None:
            return chr(_CONTROL[c])
        if c.isascii() and not c.isalnum() and c not in "<>":
            return c
        self.fail("this escape isn't supported")

    def bracket(self) -> _Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out, first, texts = [], True, set()
        while True:
            if not self.peek():
                self.fail("a class isn't closed")
            if self.peek() == "]" and not first:
                self.take()
                break
            if self.peek(2) in ("&&", "--", "~~"):
                self.fail("operations on classes aren't supported")
            java, one = self.item()
            out.append(java)
            texts.add(fold(one) if one else None)
            first = False
        java = "[" + ("^" if negated else "") + "".join(out) + "]"
        if negated or None in texts or len(texts) > _MOST_TEXTS:
            return _Node(java)
        return _Node(java, *texts) if len(texts) == 1 else _Node(java, None, "", "", frozenset(texts))

    def item(self) -> tuple[str, str | None]:
        """Java's spelling of an item of a class; and its character, where it is but one."""
        c = self.take()
        if c == "[":
            if self.peek() != ":":
                self.fail("a class within a class isn't supported")
            name, closed, _ = self.text[self.at + 1 :].partition(":]")
            negated = name.startswith("^")
            if not closed or name.lstrip("^") not in _POSIX:
                self.fail("this named class isn't supported")
            self.at += len(name) + 3
            if negated:
                self.fail("a negated named class isn't supported")
            if self.fold and name in ("lower", "upper", "alpha", "alnum", "word"):
                return _POSIX[name].replace("a-z", "").replace("A-Z", "") + "A-Za-z\\x{17F}\\x{212A}", None
            return _POSIX[name], None
        if c == "\\":
            e = self.take()
            if e in _PERL:
                return "\\" + e, None
            if e in "pP":
                return self.property(e == "P"), None
            low = self.escaped(e)
        else:
            low = c
        if self.peek() == "-" and self.peek(2) not in ("-]", "--") and len(self.peek(2)) == 2:
            self.take()
            c = self.take()
            if c == "[":
                self.fail("a range's end isn't a character")
            if c == "\\":
                e = self.take()
                if e in _PERL or e in "pP":
                    self.fail("a range's end isn't a character")
                c = self.escaped(e)
            if c < low:
                self.fail("a range runs backwards")
            return self.range(low, c), None
        others = _others(low) if self.fold else ()
        return "".join(map(_quoted, (low, *others))), low

    def range(self, low: str, high: str) -> str:
        out = f"{_quoted(low)}-{_quoted(high)}"
        if self.fold:
            cased = _cased()
            inside = cased[bisect.bisect_left(cased, low) : bisect.bisect_right(cased, high)]
            out += "".join(map(_quoted, sorted({x for c in inside for x in _others(c) if not low <= x <= high})))
        return out


@functools.cache
def parsed(pattern: str, case_sensitive: bool = False) -> _Node:
    """The pattern for java.util.regex with the same matches, and what they hold; or DialectError."""
    parser = _Parser(pattern, not case_sensitive)
    before = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(before + 8 * _DEEPEST)  # groups within groups
        out = parser.alternation()
    finally:
        sys.setrecursionlimit(before)
    if parser.at < len(pattern):
        parser.fail("a group isn't open")
    return out


def to_java(pattern: str, case_sensitive: bool = False) -> str:
    return FLAGS + parsed(pattern, case_sensitive).java


def gate_texts(pattern: str, case_sensitive: bool = False) -> tuple[str, ...]:
    """Texts of which any match holds at least one, folded as by fold(); () where none is known, or any line may hold it."""
    need = parsed(pattern, case_sensitive).needed()
    return tuple(sorted(need)) if all(len(t) > 1 or not t.isascii() for t in need) else ()


def expand_phrase(phrase: str) -> str:
    """The pattern of a phrase, in which a space stands for one or more white-space characters."""
    return phrase.replace(" ", r"\s+")
